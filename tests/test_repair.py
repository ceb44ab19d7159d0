import pytest
from pyspark.sql import functions as F

from sqlloom import samples
from sqlloom.operators.diagnose import diagnose
from sqlloom.operators.mutate import MUTATIONS, build_corpus, yields
from sqlloom.operators.repair import repair
from sqlloom.sources.catalog import from_wire

ROWS = "id long, db_id string, sql string"
#: Texts that nothing repairs.
MORE = [
    ("SELECT p_name FROM part WHERE p_size = 'unknown'", None),
]


def norm(s):
    return " ".join(s.lower().replace(";", "").split())


@pytest.fixture(scope="module")
def star(spark):
    return from_wire(spark, "star", samples.WIRE)


SEVERAL = [
    ("SELECT p_nmae, count(*) FROM part WHERE p_size > 'thirty'", "SELECT p_name, count(*) FROM part WHERE p_size > 30 GROUP BY p_name", ["UNKNOWN_COLUMN", "DATATYPE_MISMATCH", "SEMANTIC_ERROR"]),
    ("SELEC p_name, count(*) FORM prt WHERE p_size > 'thirty'", "SELECT p_name, count(*) FROM part WHERE p_size > 30 GROUP BY p_name", ["SYNTAX_ERROR", "SYNTAX_ERROR", "UNKNOWN_TABLE", "DATATYPE_MISMATCH", "SEMANTIC_ERROR"]),
    ("SELECT r_nmae, r_naem, r_nam, r_namee, r_regionky, r_rgionkey, r_regonkey, r_reginkey, r_regiokey FROM region", "SELECT r_name, r_name, r_name, r_name, " + ", ".join(["r_regionkey"] * 5) + " FROM region", ["UNKNOWN_COLUMN"] * 9),
]
PAIRS = [tuple(x.replace("{n}", "7") for x in p) for p in samples.BROKEN] + MORE
AMBIGUOUS = "SELECT n_name FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey"
OTHERS = [AMBIGUOUS, "SELECT s_name FROM supplier", None, ""]


@pytest.fixture(scope="module")
def repaired(spark, star):
    """All cases in one call, so that they share its rounds; a policy closes table supplier for the last ones."""
    texts = [a for a, _ in PAIRS] + [c[0] for c in SEVERAL] + OTHERS
    q = spark.createDataFrame([(i, "star", a, i >= len(PAIRS) + len(SEVERAL)) for i, a in enumerate(texts)], ROWS + ", closed boolean")
    closed = F.struct(F.array(F.lit("supplier")).alias("restricted_tables"), F.array().cast("array<string>").alias("restricted_columns"))
    return {r["id"]: r for r in repair(q.withColumn("policy", F.when(F.col("closed"), closed)).drop("closed"), star).collect()}


def test_repairs(repaired):
    got = repaired
    wrong = [(a, b, got[i]["repaired_query"], got[i]["remaining_error"]) for i, (a, b) in enumerate(PAIRS) if (norm(got[i]["repaired_query"]) != norm(b) or not got[i]["success"] if b else got[i]["success"])]
    assert not wrong, "\n".join(map(str, wrong))
    assert got[len(PAIRS) - 1]["remaining_error"] == "DATATYPE_MISMATCH" and "Remaining problem" in got[len(PAIRS) - 1]["explanation"]
    steps = [[s["error_class"] for s in got[i]["steps"]] for i in range(len(PAIRS))]
    assert steps[16] == ["SYNTAX_ERROR", "SYNTAX_ERROR", "UNKNOWN_TABLE", "UNKNOWN_COLUMN"] and steps[17] == []


def test_faults_of_several_kinds_are_steps(spark, star, repaired):
    for i, (_, want, classes) in enumerate(SEVERAL, len(PAIRS)):
        assert norm(repaired[i]["repaired_query"]) == norm(want) and [s["error_class"] for s in repaired[i]["steps"]] == classes, repaired[i]
    # an upper bound of rounds is told apart from being stuck
    (cut,) = repair(spark.createDataFrame([(2, "star", SEVERAL[2][0])], ROWS), star, rounds=1).collect()
    assert len(cut["steps"]) == 1 and not cut["success"] and cut["remaining_error"] == "UNKNOWN_COLUMN"


def test_ambiguous_names_and_policies(repaired):
    got = [repaired[len(PAIRS) + len(SEVERAL) + i] for i in range(4)]
    assert got[0]["success"] and norm(got[0]["repaired_query"]) in {AMBIGUOUS.replace("SELECT n_name", f"SELECT {x}.n_name").lower() for x in "ab"}
    assert not got[1]["success"] and got[1]["remaining_error"] == "PERMISSION_DENIED" and not got[1]["steps"]
    assert [x["remaining_error"] for x in got[2:]] == ["SYNTAX_ERROR"] * 2


def test_corpus_is_verified_balanced_and_unique(spark, star):
    base = spark.createDataFrame([("star", s.replace("{n}", "7").replace("{s}", "x")) for s in samples.SEEDS], "db_id string, sql string")
    c = build_corpus(base, star, per_label=5).cache()
    rows = c.collect()
    assert {r["label"] for r in rows} == {"CORRECT", "SYNTAX_ERROR", "UNKNOWN_TABLE", "UNKNOWN_COLUMN", "DATATYPE_MISMATCH", "AMBIGUOUS_REFERENCE", "SEMANTIC_ERROR"}
    assert len({norm(r["sql"]) for r in rows}) == len(rows) and max(sum(r["label"] == x for r in rows) for x in {r["label"] for r in rows}) <= 5
    again = diagnose(c.withColumn("id", c["sql"]).select("id", "db_id", "sql", "label"), star)
    assert again.filter("error_class <> label").count() == 0
    other = build_corpus(base.repartition(5), star, per_label=5).collect()
    assert {(r["sql"], r["label"]) for r in other} == {(r["sql"], r["label"]) for r in rows}
    y = {r["mutation"]: r["verified"] for r in yields(base, star).collect()}
    assert len(MUTATIONS) == 28 and sum(v > 0 for v in y.values()) >= 22, y
