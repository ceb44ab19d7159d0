import pytest
from pyspark.sql import functions as F

from sqlloom import samples
from sqlloom.functions.scopes import Query
from sqlloom.operators import diagnose as D
from sqlloom.operators.diagnose import diagnose
from sqlloom.sources.catalog import from_wire

ROWS = "id long, db_id string, sql string"


@pytest.fixture(scope="module")
def star(spark):
    return from_wire(spark, "star", samples.WIRE)


def verdicts(spark, star, texts, db="star", policy=None):
    q = spark.createDataFrame([(i, db, s) for i, s in enumerate(texts)], ROWS)
    if policy:
        q = q.withColumn("policy", F.struct(*(F.array(*map(F.lit, x)).alias(n) for n, x in zip(("restricted_tables", "restricted_columns"), policy, strict=True))))
    return {r["id"]: r for r in diagnose(q, star).collect()}


def check(got, cases):
    wrong = [(s, want, got[i]["error_class"], [x["message"] for x in got[i]["issues"]]) for i, (s, want) in enumerate(cases) if got[i]["error_class"] != want]
    assert not wrong, wrong
    assert all(bool(r["issues"]) == (r["error_class"] != "CORRECT") and (not r["issues"] or r["issues"][0]["error_class"] == r["error_class"]) for r in got.values())


def test_templates(spark, star):
    cases = [(t.replace("{n}", "7").replace("{s}", "x"), label) for t, label in samples.LABELLED]
    check(verdicts(spark, star, [s for s, _ in cases]), cases)


MORE = [
    ("SELECT c_name, c_custkey, (SELECT max(o_totalprice) FROM orders) FROM customer", "CORRECT"),
    ("SELECT c_name, count(*) OVER (PARTITION BY c_mktsegment) FROM customer", "CORRECT"),
    ("SELECT count(*), sum(count(*)) OVER () FROM customer GROUP BY c_mktsegment", "CORRECT"),
    ("SELECT o.o_orderkey, l.l_linenumber, count(*) FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY l.l_orderkey, l.l_linenumber", "CORRECT"),
    ("SELECT l_quantity FROM lineitem GROUP BY l_orderkey", "SEMANTIC_ERROR"),
    ("SELECT c_mktsegment AS seg, count(*) FROM customer GROUP BY seg", "SEMANTIC_ERROR"),
    ("SELECT c_name FROM customer GROUP BY 1", "CORRECT"),
    ("SELECT o_orderkey FROM orders NATURAL JOIN lineitem", "CORRECT"),
    ("SELECT a.c_name FROM customer AS a JOIN customer AS b USING (c_custkey)", "CORRECT"),
    ("SELECT a.k FROM (SELECT c_custkey AS k FROM customer) a JOIN (SELECT o_custkey AS k FROM orders) b ON a.k = b.k", "CORRECT"),
    ("SELECT c_name FROM customer, orders WHERE (c_custkey = o_custkey OR o_totalprice > 5) AND c_acctbal > -5", "CORRECT"),
    ("SELECT c_name FROM customer, orders WHERE c_custkey = 3 AND o_orderkey = 5", "SEMANTIC_ERROR"),
    ("SELECT c_name FROM customer JOIN orders ON 1 = 1", "SEMANTIC_ERROR"),
    ("SELECT c_name FROM customer WHERE c_acctbal + 1 = c_acctbal", "CORRECT"),
    ("SELECT c_name FROM customer WHERE NOT c_custkey >= c_custkey", "SEMANTIC_ERROR"),
    ("SELECT c_name FROM customer WHERE c_name = '5' AND c_acctbal = '5.5'", "CORRECT"),
    ("SELECT c_name FROM customer WHERE c_name LIKE 5", "CORRECT"),
    ("SELECT CAST(c_acctbal AS TEXT) || 'x' FROM customer -- c_name = 5", "CORRECT"),
    ("SELECT c_name FROM customer ORDER BY 'x' = c_acctbal", "DATATYPE_MISMATCH"),
    ("SELECT CASE WHEN c_acctbal > 'a' THEN 1 END FROM customer", "DATATYPE_MISMATCH"),
    ("SELECT total(c_name) FROM customer", "CORRECT"),
    ("SELECT ((((c_nme)))) FROM customer", "UNKNOWN_COLUMN"),
    ("SELECT c_name FROM customer WHERE ((((((c_acctbal = 'x'))))))", "DATATYPE_MISMATCH"),
    ("UPDATE customer SET c_name = 'x' WHERE c_custkey = 1", "CORRECT"),
    ("", "SYNTAX_ERROR"), (" ;; ", "SYNTAX_ERROR"), (None, "SYNTAX_ERROR"), ("VACUUM", "SYNTAX_ERROR"), ("ATTACH DATABASE '/tmp/none.db' AS x", "SYNTAX_ERROR"),
    ("SELECT c_nme FORM customers", "SYNTAX_ERROR"),
]


def test_scopes_types_and_odd_texts(spark, star):
    check(verdicts(spark, star, [s for s, _ in MORE]), MORE)


def test_policies_are_exact(spark, star):
    texts = [t.replace("{n}", "7") for t, _ in samples.GUARDED]
    got = verdicts(spark, star, texts, policy=samples.CLOSED)
    assert [(t, got[i]["error_class"] == "PERMISSION_DENIED") for i, t in enumerate(texts)] == [(t, denied) for t, (_, denied) in zip(texts, samples.GUARDED, strict=True)]
    assert [x["token"] for x in got[2]["issues"] if x["source"] == "policy"] == ["customer.c_acctbal"]
    # grammar comes first, unknown names come with what is closed
    got = verdicts(spark, star, ["SELECT s_nme FROM supplier", "SELECT s_name FORM supplier"], policy=samples.CLOSED)
    assert {x["error_class"] for x in got[0]["issues"]} == {"UNKNOWN_COLUMN", "PERMISSION_DENIED"} and got[1]["error_class"] == "SYNTAX_ERROR"


def test_without_a_schema(spark, star):
    cases = [
        ("SELECT a FROM t WHERE b > 1", "CORRECT"), ("SELECT a FROM t WHRE b > 1", "SYNTAX_ERROR"), ("SELECT a FROM t WHERE b = NULL", "SEMANTIC_ERROR"),
        ("SELECT a FROM t WHERE sum(b) > 1", "SEMANTIC_ERROR"), ("SELECT cnt(a) FROM t", "SEMANTIC_ERROR"), ("SELECT a, count(*) FROM t", "SEMANTIC_ERROR"),
        ("SELECT x.a, y.b FROM t AS x JOIN u AS y ON x.i = y.i WHERE x.a = 'z'", "CORRECT"), ("SELECT a FROM t WHERE a IN (SELECT b, c FROM u)", "SEMANTIC_ERROR"), ("WITH q AS (SELECT a FROM t) SELECT a FROM q", "CORRECT"),
    ]
    got = verdicts(spark, star, [s for s, _ in cases], db="unknown")
    check(got, cases)
    assert not any(r["schema_checked"] for r in got.values())


def test_schemas_travel_with_the_rows_when_large(spark, star, monkeypatch):
    cases = [(t.replace("{n}", "7").replace("{s}", "x"), label) for t, label in samples.LABELLED[::4]]
    monkeypatch.setattr(D, "SHIPPED", 0)
    check(verdicts(spark, star, [s for s, _ in cases]), cases)


def test_facts_of_a_text():
    q = Query("SELECT a.x AS k, sum(DISTINCT b.y) FROM t AS a LEFT JOIN \"u\" b ON a.i = b.j WHERE a.x BETWEEN 1 AND 'z' GROUP BY a.x", {"t": {"x": "number", "i": "number"}, "u": {"y": "text", "j": "number"}}, {"t": ["i"]})
    (s,) = q.scopes
    assert [(x["alias"], x["t"], x["keys"]) for x in s["sources"]] == [("a", "t", ["i"]), ("b", "u", [])] and q.named == ["t", "u"]
    assert [(x["text"], x["alias"], x["folds"]) for x in s["items"]] == [("a.x", "k", False), ("sum(distinct b.y)", "", True)]
    assert s["loose"] == [] and s["fixed"] == ["t.x"] and s["summed"] == [{"text": "b.y", "type": "text"}]
    assert [(x["op"], x["kind"], x["value"]) for x in s["compared"] if x["op"] == "between"] == [("between", "number", "1"), ("between", "string", "z")]
    assert Query("", {}, {}).scopes == [] and Query("((((", {}, {}).scopes == [] and len(Query("SELECT 1 FROM (SELECT 2 UNION SELECT 3)", {}, {}).scopes) == 3
