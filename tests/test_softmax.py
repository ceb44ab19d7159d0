"""Blocks of texts: their features and steps are those of pyspark.ml's vectors."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from sqlloom.operators import baseline, softmax

TEXTS = [f"SELECT a FROM t WHERE b = {n} AND a IN ({n % 7}, '{n}');" if n % 3 else f"SELEC 1 a{n},a FORM  t{n % 5} t t" for n in range(400)] + ["", "  ", None, "Größe\tÉTÉ a a", "'5 5 5' x-1-1 1", "a" * 3000]


@pytest.fixture(scope="module")
def parts():
    """Labels, terms, idf and random weights for the terms in two texts or more."""
    found = [{g: n for g, n in zip(total, texts_with.values(), strict=True) if n > 1} for _, total, texts_with in counted(TEXTS)]
    rng = np.random.default_rng(7)
    return {"labels": ["x", "y"], "terms": [list(t) for t in found], "idf": [np.log((len(TEXTS) + 1) / (np.array(list(t.values())) + 1)) for t in found], "coefficients": rng.normal(size=(3, sum(map(len, found)))), "intercept": rng.normal(size=3), "sublinear": True}


def counted(texts):
    return [(k, total, {g: n[g] for g in total}) for k, total, n in softmax.term_counts(texts)]


def test_counts_are_those_of_each_text():
    for k, total, texts_with in counted(TEXTS):
        grams = [baseline.features_of(x or "")[k] for x in TEXTS]
        assert total == {g: sum(x.count(g) for x in grams if g in x) for g in {g for x in grams for g in x}}
        assert texts_with == {g: sum(g in x for x in map(set, grams)) for g in total}


def features(scorer, text):
    """For each kind: places of the text's terms, their counts, their values (of unit length)."""
    out = []
    for places, idf, grams in zip(scorer.places, scorer.idf, baseline.features_of(text or ""), strict=True):
        at, n = np.unique(np.array([places[g] for g in grams if g in places], np.int64), return_counts=True)
        v = (1 + np.log(n) if scorer.sublinear else n.astype(float)) * idf[at]
        norm = np.sqrt((v * v).sum())
        out.append((at, n, v / norm if norm > 0 else v))
    return out


@pytest.mark.parametrize("sublinear", [True, False])
def test_blocks_hold_the_features_of_each_text(parts, sublinear):
    parts = parts | {"sublinear": sublinear}
    scorer = baseline.Scorer(parts)
    terms = len(parts["terms"][0]) + len(parts["terms"][1])
    block = softmax.Block.unpacked(softmax.Block.of(TEXTS, [0] * len(TEXTS), scorer.places, parts["idf"], sublinear).packed())
    assert 0 < block.patterns < 40 and len(block.hit)
    want = np.zeros((len(TEXTS), terms))
    for row, x in zip(want, TEXTS, strict=True):
        for start, (at, _, v) in zip(scorer.start, features(scorer, x), strict=True):
            row[start + at] = v
    assert block.margins(parts["coefficients"], parts["intercept"]) == pytest.approx(parts["coefficients"] @ want.T + parts["intercept"][:, None], abs=1e-12)
    weights = np.random.default_rng(3).normal(size=len(TEXTS))
    assert block.summed(weights, terms) == pytest.approx(weights @ want, abs=1e-12) and block.summed(weights, terms, squared=True) == pytest.approx(weights @ want**2, abs=1e-12)


def test_steps_are_those_of_vectors(spark, parts):
    """The same objective at each step."""
    scorer, texts = baseline.Scorer(parts), TEXTS[:120]
    terms = len(parts["terms"][0]) + len(parts["terms"][1])
    y = [0 if x.startswith("SELEC ") else 1 + n % 2 for n, x in enumerate(texts)]
    vectors = [(float(c), Vectors.sparse(terms, {int(start + i): float(w) for start, (at, _, v) in zip(scorer.start, features(scorer, x), strict=True) for i, w in zip(at, v, strict=True)})) for c, x in zip(y, texts, strict=True)]
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-3, standardization=False, maxIter=30, family="multinomial").fit(spark.createDataFrame(vectors, ["y", "x"]))
    blocks = [softmax.Block.of(texts[i : i + 50], y[i : i + 50], scorer.places, parts["idf"], True).packed() for i in range(0, 120, 50)]
    data = spark.createDataFrame([(b,) for b in blocks], f"x struct<{', '.join(f'{k}: binary' for k in softmax.Block.FIELDS)}>")
    for once in (64, 0):
        softmax.ONCE_MB, before = once, softmax.ONCE_MB
        try:
            weights, intercept, values = softmax.regression(data, "x", 3, terms, 1e-3, 30, 1e-6)
        finally:
            softmax.ONCE_MB = before
        assert values == pytest.approx(model.summary.objectiveHistory, rel=1e-7)
        assert weights == pytest.approx(model.coefficientMatrix.toArray(), abs=1e-5) and intercept == pytest.approx(model.interceptVector.toArray(), abs=1e-5)


def test_regression_reads_blocks(spark, monkeypatch):
    """What each step reads grows with the texts' own terms: no row for each text, nor a place for each of its terms."""
    seen, plain = [], baseline.LogisticRegression._fit
    monkeypatch.setattr(baseline.LogisticRegression, "_fit", lambda self, data: seen.append(data.collect()) or plain(self.setMaxIter(2), data))
    texts = [(f"SELECT c_name FROM customer WHERE c_acctbal > {n} ORDER BY c_name", "fine") if n % 2 else (f"SELEC c_name FORM customer WHERE c_acctbal > {n}", "broken") for n in range(1000)]
    baseline.fit(spark.createDataFrame(texts, "text string, label string").coalesce(2))
    assert len(seen[0]) <= 4 and sum(len(r["_x"]["at"]) for r in seen[0]) < 4 * 30 * len(texts)


@pytest.mark.parametrize("sublinear", [True, False])
def test_words_of_texts_are_those_of_each_text(parts, sublinear):
    """A batch's patterns change no text's words; each is worked out here from its own features."""
    scorer = baseline.Scorer(parts | {"sublinear": sublinear})
    assert scorer.probabilities(TEXTS) == pytest.approx(np.concatenate([scorer.probabilities([x]) for x in TEXTS]), abs=1e-12)
    for x, (label, words) in zip(TEXTS, scorer.words(TEXTS), strict=True):
        f, want = features(scorer, x), {}
        y = int((scorer.intercept + sum(scorer.weights[:, s + at] @ v for s, (at, _, v) in zip(scorer.start, f, strict=True)))[:2].argmax())
        each = [{int(i): v * scorer.weights[y, s + i] / n for i, n, v in zip(*g, strict=True)} for s, g in zip(scorer.start, f, strict=True)]
        for g in baseline.features_of(x or "")[0]:
            for w in g.split(" ") if scorer.places[0].get(g) in each[0] else ():
                want[w] = want.get(w, 0.0) + each[0][scorer.places[0][g]] / len(g.split(" "))
        for run in softmax.runs_of(x or ""):
            for g in softmax.grams_of(run):
                if scorer.places[1].get(g) in each[1]:
                    want[run] = want.get(run, 0.0) + each[1][scorer.places[1][g]]
        assert label == scorer.labels[y] and words == pytest.approx(want, abs=1e-12)


def test_work_of_alike_texts_is_shared(parts, monkeypatch):
    """Grams are made for the texts' own runs and once for each pattern, not for every run of every text."""
    scorer, made, plain = baseline.Scorer(parts), [], softmax.grams_of
    monkeypatch.setattr(softmax, "grams_of", lambda run: made.append(run) or plain(run))
    monkeypatch.setattr(baseline, "grams_of", softmax.grams_of)
    texts = [f"SELECT a FROM t WHERE b = {n} AND a = 7" for n in range(1000)]
    assert len(list(scorer.words(texts))) == 1000 and len(scorer.probabilities(texts)) == 1000
    assert len(made) < 4 * len(texts)
