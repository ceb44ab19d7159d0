"""The baseline model: saved transformer, batched inference, attribution."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sqlloom.operators import baseline

TEXTS = [
    ("SELECT a FROM t WHERE a = 1", "fine"), ("SELECT a, b FROM t WHERE b = 2", "fine"), ("SELECT b FROM t GROUP BY b", "fine"), ("SELECT count(*) FROM t", "fine"),
    ("SELEC a FORM t", "broken"), ("SELECT FROM WHERE", "broken"), ("FORM t SELEC b", "broken"), ("SELECT a FORM t WHERE", "broken"),
    ("SELECT x FROM nowhere", "lost"), ("SELECT a FROM nowhere WHERE a = 2", "lost"), ("SELECT y FROM nowhere GROUP BY y", "lost"),
] * 2


@pytest.fixture(scope="module")
def model(spark):
    return baseline.fit(spark.createDataFrame(TEXTS, "text string, label string"))


@pytest.fixture(scope="module")
def rows(spark):
    texts = [t for t, _ in TEXTS[:11]] + ["", "Größe ÉTÉ a a a\tFROM  nowhere", "unseen words only zzz", "a", "SELECT a FROM t " * 50]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("y", F.lit(1))


def test_sublinear_frequencies_are_saved(spark, model, rows, tmp_path):
    df = spark.createDataFrame([(Vectors.sparse(5, [1, 3], [1.0, 7.0]),), (Vectors.sparse(5, [], []),)], ["v"])
    out = [r["w"] for r in baseline.SublinearTF(inputCol="v", outputCol="w").transform(df).collect()]
    assert out == [Vectors.sparse(5, [1, 3], [1.0, 1 + math.log(7)]), Vectors.sparse(5, [], [])]
    path = f"file://{tmp_path}/m"
    baseline.save(model, path, {"rows": 22})
    again, facts = baseline.load(path)
    assert facts == {"rows": 22}
    a, b = (baseline.predict(m, rows).orderBy("id").collect() for m in (model, again))
    assert a == b and any(type(s).__name__ == "SublinearTF" for s in again.stages)


def test_batches_as_the_pipeline(model, rows):
    one, two = (f(model, rows).orderBy("id") for f in (baseline.predict, baseline.predict_batched))
    assert one.columns == two.columns
    for a, b in zip(one.collect(), two.collect(), strict=True):
        assert a["probabilities"] == pytest.approx(b["probabilities"], abs=1e-9) and a["confidence"] == pytest.approx(b["confidence"], abs=1e-9)
        assert a["y_pred"] == b["y_pred"] or sorted(a["probabilities"].values())[-1] - sorted(a["probabilities"].values())[-2] < 1e-9
    assert baseline.predict_batched(model, rows.limit(0)).count() == 0


def test_contributions_add_up_to_the_margin(model, rows):
    lr = next(s for s in model.stages if type(s).__name__ == "LogisticRegressionModel")
    want = {r["id"]: r["rawPrediction"][int(r["prediction"])] - lr.interceptVector[int(r["prediction"])] for r in model.transform(rows).collect()}
    terms = baseline.contributions(model, rows)
    assert terms.columns == ["id", "label", "kind", "term", "count", "contribution"]
    total = {r["id"]: r["s"] for r in terms.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    words = {r["id"]: r["s"] for r in baseline.word_contributions(model, rows).groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    for i, margin in want.items():
        assert total.get(i, 0.0) == pytest.approx(margin, abs=1e-9) and words.get(i, 0.0) == pytest.approx(margin, abs=1e-9)
    by_word = {(r["id"], r["word"]): r["contribution"] for r in baseline.word_contributions(model, rows).collect()}
    assert max((w for i, w in by_word if i == 8), key=lambda w: by_word[8, w]) == "nowhere"


def test_features_by_hand(spark):
    words, chars = baseline.features_of("Ab c\tab")
    assert words == ["ab", "c", "ab", "ab c", "c ab", "ab c ab"]
    sql = spark.sql(f"SELECT flatten(transform(filter(split(lower('Ab c\\tab'), '\\\\s+'), w -> w <> ''), w -> {baseline.GRAMS})) AS g").first()["g"]
    assert chars == sql and np.isclose(len(chars), len(sql))


def test_regression_reads_plain_vectors(spark, model, monkeypatch):
    seen, plain = [], baseline.LogisticRegression._fit
    monkeypatch.setattr(baseline.LogisticRegression, "_fit", lambda self, data: seen.append(data) or plain(self, data))
    train = spark.createDataFrame(TEXTS, "text string, label string").repartition(9)
    baseline.fit(train)
    # no object for each term in the plan, and no partition beyond the cores
    assert seen[0].schema["_x"].metadata == {} and seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    whole = baseline.pipeline(["broken", "fine", "lost"], rows=22).fit(train)
    a, b = baseline._parts(model), baseline._parts(whole)
    assert [sorted(x) for x in a["terms"]] == [sorted(x) for x in b["terms"]] and a["coefficients"].shape == b["coefficients"].shape
    probe = spark.createDataFrame([(0, "SELECT a FROM nowhere"), (1, "FORM a SELEC"), (2, "")], "id long, text string")
    for x, y in zip(*(baseline.predict(m, probe).orderBy("id").collect() for m in (model, whole)), strict=True):
        assert x["probabilities"] == pytest.approx(y["probabilities"], abs=1e-4)


def test_word_contributions_shuffle_no_terms(model, rows):
    assert "Exchange" not in baseline.word_contributions(model, rows)._jdf.queryExecution().executedPlan().toString()
