"""Texts that differ in values only: rules are applied once to those of a batch, and tell what they would tell of each."""

import pytest
from pyspark.sql import functions as F
from sqlloom import samples
from sqlloom.functions.scopes import MARK, pattern_of
from sqlloom.functions.text import normalize_query
from sqlloom.operators import diagnose as D
from sqlloom.sources.catalog import from_wire

VALUES = ("5", "6", "'5'", "'6'", "5.25", "'x'", "'y'", "''", "' 7 '", "'5\u0085'", "'it''s'", "'X'", "'_'", "0x5", "-5", "NULL", "c_name")
TEXTS = (
    "SELECT c_name FROM customer WHERE c_acctbal = {} AND c_name = {}", "SELECT c_name FROM customer WHERE c_acctbal IN ({}, 3, {}) OR c_name NOT IN ({})", "SELECT c_name FROM customer WHERE c_acctbal BETWEEN {} AND {}",
    "SELECT c_name = {}, count(*) FROM customer GROUP BY c_name = 'x'", "SELECT c_name = {}, count(*) FROM customer GROUP BY c_name = /**/ {}", "SELECT c_acctbal IN ({}, 'x'), count(*) FROM customer GROUP BY c_acctbal IN (5, 'x')",
    "SELECT c_name FROM customer WHERE {} = NULL AND 5 = NULL", "SELECT c_name FROM customer WHERE c_name = {} {}", "SELECT c_name FROM customer WHERE c_name = {} UNION SELECT s_name FROM supplier WHERE s_acctbal < {}",
    "SELECT c_name = {} FROM customer UNION SELECT s_name FROM supplier ORDER BY c_name = {}", "SELECT c_name IN (5) FROM customer UNION SELECT s_name FROM supplier ORDER BY c_name IN ({})", "SELECT * FROM (SELECT c_acctbal IN ({}) FROM customer) WHERE \"c_acctbal IN (5)\" = 1",
    "SELECT c_nme FROM customer WHERE c_name = {}", "SELECT s_name FROM supplier WHERE s_acctbal > {}", "SELECT c_name FROM customer WHERE c_name = 'x = {}", "SELECT c_name FROM customer -- IN ({})\n WHERE c_acctbal >= {}",
)


@pytest.fixture(scope="module")
def star(spark):
    return from_wire(spark, "star", samples.WIRE)


def test_shared_verdicts_are_those_of_each_text(spark, star):
    texts = [t.replace("{}", v) for t in TEXTS for v in VALUES] + [t.replace("{}", v, 1).replace("{}", "5") for t in TEXTS for v in VALUES]
    closed = [None, (["supplier"], ["customer.c_acctbal"]), ([], None), (None, None)]
    rows = [(f"{i}.{k}.{db}", db, s, p) for i, s in enumerate(texts) for k, p in enumerate(closed) for db in ("star", "unknown")]
    q = spark.createDataFrame(rows, "id string, db_id string, sql string, policy struct<restricted_tables: array<string>, restricted_columns: array<string>>")
    # a text that holds the mark has no pattern, so it is checked by itself
    alone = q.withColumn("sql", F.concat(F.lit(f"/*{MARK}*/ "), F.col("sql")))
    assert not any(pattern_of(f"/*{MARK}*/ {s}") for s in texts)
    got, want = ({r["id"]: r for r in D.diagnose(x, star).collect()} for x in (q, alone))
    assert got.keys() == want.keys() and len(got) == len(rows)
    for i, _, s, p in rows:
        assert got[i]["sql"] == s and got[i]["policy"] == p
        assert [got[i][c] for c in ("error_class", "issues", "engine_error", "schema_checked")] == [want[i][c] for c in ("error_class", "issues", "engine_error", "schema_checked")], s


def test_rules_are_applied_once_to_texts_that_are_alike(spark, star):
    """Orders' texts, as diagnose_corpus makes them: rows that rules look at grow with the templates, not with the texts."""
    texts = [(n * len(samples.LABELLED) + i, "star", t.replace("{n}", str(n + 100)).replace("{s}", f"{n % 5}-HIGH"), label) for n in range(1100) for i, (t, label) in enumerate(samples.LABELLED) if "SELECT 1;" not in t]
    q = spark.createDataFrame(texts, "id long, db_id string, sql string, label string").coalesce(1)
    found = D.compiled(q.withColumn("_policy", F.lit(None).cast("string")).withColumn("_q", normalize_query(F.col("sql"))), star, q.columns).select(F.size("_rows").alias("n")).collect()
    assert sum(r["n"] for r in found) == len(texts) and max(r["n"] for r in found) <= D.HELD
    assert len(found) < len(texts) / 50
    assert D.diagnose(q, star).filter("error_class <> label").count() == 0


def test_lists_bounds_and_set_operations_have_patterns():
    patterns = {p[0] if (p := pattern_of(t.replace("{n}", str(n)))) else (n, t) for n in (12, 345) for t, _ in samples.LABELLED if "SELECT 1;" not in t}
    assert len(patterns) == len(samples.LABELLED) - 1
