"""Tables that change in parts, and sketches that merge."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sqlloom.functions.tokens import token_rows, with_clause_ends
from sqlloom.operators import browse, corpus, history, sketches

ROWS = "k long, v string"


def stamps(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def held(spark, path):
    return sorted(map(tuple, spark.read.parquet(f"file://{path}").select("k", "v").collect()))


def test_upserts_touch_only_their_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    history.store(spark.createDataFrame([(i, f"v{i}") for i in range(200)], ROWS), f"file://{path}", "k", parts=32)
    want, before = {i: f"v{i}" for i in range(200)}, stamps(path)
    changes = spark.createDataFrame([(3, "new", False), (7, None, True), (500, "more", False), (900, "never there", True)], ROWS + ", deleted boolean")
    touched = history.upsert_into(f"file://{path}", changes, "k", parts=32)
    want |= {3: "new", 500: "more"}
    del want[7]
    assert held(spark, path) == sorted(want.items()) and 1 <= len(touched) <= 4
    same = {f: t for f, t in before.items() if int(f.split("/")[0].removeprefix("_part=")) not in touched}
    assert same.items() <= stamps(path).items() and len(same) >= 28
    # again, as after a retry; no changes; a part that loses all its rows
    assert history.upsert_into(f"file://{path}", changes, "k", parts=32) == touched and held(spark, path) == sorted(want.items())
    assert history.upsert_into(f"file://{path}", changes.limit(0), "k", parts=32) == []
    part = spark.read.parquet(f"file://{path}").filter(F.col("_part") == touched[0]).select("k", "v").collect()
    history.upsert_into(f"file://{path}", spark.createDataFrame([(r["k"], None, True) for r in part], ROWS + ", deleted boolean"), "k", parts=32)
    assert held(spark, path) == sorted(x for x in want.items() if x[0] not in {r["k"] for r in part})


def test_sketches_merge(spark, tmp_path):
    rng, at = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(days=rng.randrange(9)), "ab"[rng.random() < 0.3], rng.randrange(5000), rng.gauss(0, 10)) for _ in range(30_000)] + [(at, "a", None, None), (at, "none", None, None)]
    e, path = spark.createDataFrame(rows, "ts timestamp, g string, u long, x double"), f"file://{tmp_path}/s"
    sketches.store(sketches.by_day(e, "ts", ["g"], "u", "x"), path)
    sketches.store(sketches.by_day(e.filter("day(ts) = 2"), "ts", ["g"], "u", "x"), path)  # one day again
    stored = spark.read.parquet(path)
    for span in (None, "2024-01-02", "2024-01-05"):
        kept = [r for r in rows if span is None or str(r[0].date()) <= span]
        got = {r["g"]: r for r in sketches.merged(stored if span is None else stored.filter(F.col("day") <= span), ["g"], (0.1, 0.5, 0.99)).collect()}
        for g in "ab":
            users, xs = {r[2] for r in kept if r[1] == g} - {None}, [r[3] for r in kept if r[1] == g and r[3] is not None]
            assert got[g]["n"] == sum(r[1] == g for r in kept) and abs(got[g]["distinct"] - len(users)) <= sketches.DISTINCT_ERROR * len(users)
            assert [sum(x <= q for x in xs) / len(xs) for q in got[g]["quantiles"]] == pytest.approx([0.1, 0.5, 0.99], abs=sketches.RANK_ERROR)
        assert got["none"]["n"] == 1 and got["none"]["distinct"] == 0 and got["none"]["quantiles"] is None
    assert sketches.merged(stored.limit(0), ["g"], (0.5,)).count() == 0


def test_clause_ends_of_nested_texts(spark):
    texts = ["SELECT a FROM (SELECT b FROM (SELECT c FROM t) WHERE d = (1)) ORDER BY e", ")) ( ) FROM ((", "", "f(((x)))"]
    rows = token_rows(spark.createDataFrame(list(enumerate(texts)), "id long, sql string"))
    got = with_clause_ends(rows, "id").collect()
    clauses = {"SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT"}
    assert len(got) == rows.count()
    for r in got:
        later = [x for x in got if x["id"] == r["id"] and x["idx"] > r["idx"]]
        ends = [x["idx"] for x in later if (x["depth"] == r["depth"] and x["token"] in clauses) or (x["depth"] == r["depth"] - 1 and x["token"] == ")")]
        assert r["clause_end"] == min(ends, default=max([r["idx"], *(x["idx"] for x in later)]) + 1) - 1, r


def test_listed_files_and_totals(spark):
    known = spark.createDataFrame([("a", "/d/a.db"), ("b", "/d/b.db")], "db_id string, path string")
    files = spark.createDataFrame([("/d/b.db",), ("/d/b.db",), ("/d/c.db",)], "path string")
    assert [r["db_id"] for r in browse.executable(known, files).collect()] == ["b"]
    assert history.total_requests(spark.createDataFrame([("x", 2), ("y", 5)], "endpoint string, requests long")).first()[0] == 7


def test_splits_by_group_of_few_and_null_groups(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 3}") for i in range(30)], "id long, g string")
    got = corpus.split_by_group(rows, "g")
    assert got.count() == 30 and got.filter("split = 'validation'").select("g").distinct().count() == 1
    assert corpus.split_by_group(rows.limit(0), "g").count() == 0
