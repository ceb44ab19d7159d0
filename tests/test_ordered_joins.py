"""Interval, overlap and as-of joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sqlloom import queries
from sqlloom.operators.ordered_joins import asof_join, interval_join, overlap_join


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(seed, n, far=1000):
    rng = random.Random(seed)
    out = [(rng.choice([None, "a", "b", "b", "b"]), s := rng.choice([None, rng.randrange(-far, far), rng.randrange(-far, far)]), None if s is None else s + rng.choice([-3, 0, 1, 2, 5, 17, 900, 10**9]), i) for i in range(n)]
    return out + out[:5]


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp"])
def test_points_in_intervals(spark, kind):
    cast = {"date": "date_add(date'1970-01-01', cast(least({}, 100000) as int))", "timestamp": "timestamp_micros({})"}.get(kind, f"cast({{}} as {kind})")
    p = spark.createDataFrame([(k, s, i) for k, s, _, i in rows(1, 150)], "k string, s long, i long").selectExpr("k", cast.format("s") + " t", "i")
    v = spark.createDataFrame(rows(2, 80), "k string, s long, e long, i long").selectExpr("k", cast.format("s") + " s", cast.format("e") + " e", "i")
    one, two = p.collect(), v.collect()
    want = [(a["k"], a["t"], a["i"], b["k"], b["s"], b["e"], b["i"]) for a in one for b in two if None not in (a["k"], a["t"], b["k"], b["s"], b["e"]) and a["k"] == b["k"] and b["s"] <= a["t"] < b["e"]]
    got = interval_join(p, v, "t", "s", "e", on=["k"])
    assert got.columns == ["k", "t", "i", "right_k", "right_s", "right_e", "right_i"] and len(want) > 100
    same(got.collect(), want)
    want = [(a["t"], b["i"]) for a in one for b in two if None not in (a["t"], b["s"], b["e"]) and b["s"] <= a["t"] < b["e"]]
    got = interval_join(p, v, "t", "s", "e")
    same(got.select("t", "right_i").collect(), want)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_overlaps(spark):
    a, b = (spark.createDataFrame(rows(s, 90), "k string, s long, e long, i long") for s in (3, 4))
    want = [(x["i"], y["i"]) for x in a.collect() for y in b.collect() if None not in (x["k"], x["s"], y["k"], y["s"]) and x["k"] == y["k"] and x["s"] < x["e"] and y["s"] < y["e"] and x["s"] < y["e"] and y["s"] < x["e"]]
    got = overlap_join(a, b, "s", "e", on=["k"])
    same(got.select("i", "right_i").collect(), want)
    assert "NestedLoop" not in plan(got) and len(want) > 200
    renamed = b.withColumnsRenamed({"s": "from_", "e": "to_"})
    same(overlap_join(a, renamed, "s", "e", ["k"], "from_", "to_").select("i", "right_i").collect(), want)
    assert overlap_join(a.limit(0), b, "s", "e").count() == overlap_join(a, b.limit(0), "s", "e").count() == 0


def asof_by_force(one, two, direction, strict, tolerance):
    out = []
    for k, t, i in one:
        fit = [(abs(t - y), y, x) for z, y, x in two if None not in (k, t, y, z) and z == k and (tolerance is None or abs(t - y) <= tolerance)]
        back = max((f for f in fit if f[1] < t or (f[1] == t and not strict)), key=lambda f: (f[1], f[2]), default=None)
        ahead = min((f for f in fit if f[1] > t or (f[1] == t and not strict)), key=lambda f: (f[1], -f[2]), default=None)
        best = {"backward": back, "forward": ahead, "nearest": back if back and (not ahead or back[0] <= ahead[0]) else ahead}[direction]
        out.append((k, t, i, *((k, best[1], best[2]) if best else (None, None, None))))
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize(("strict", "tolerance", "pieces"), [(False, None, 10**6), (True, None, 7), (False, 40, 7), (False, None, 1)])
def test_asof(spark, direction, strict, tolerance, pieces):
    one, two = ([(k, s, i) for k, s, _, i in rows(seed, n, 300)] for seed, n in ((5, 120), (6, 60)))
    a, b = (spark.createDataFrame(x, "k string, t long, i long") for x in (one, two))
    got = asof_join(a, b, "t", ["k"], direction=direction, strict=strict, tolerance=tolerance, piece_rows=pieces)
    assert got.columns == ["k", "t", "i", "right_k", "right_t", "right_i"]
    same(got.collect(), asof_by_force(one, two, direction, strict, tolerance))


def test_asof_of_no_rows_and_without_keys(spark):
    a = spark.createDataFrame([(1, "x"), (5, "y"), (None, "z")], "t int, l string")
    b = spark.createDataFrame([(0, 1.5), (4, None)], "at int, v double")
    assert sorted(map(tuple, asof_join(a, b, "t", right_at="at").collect()), key=str) == [(1, "x", 0, 1.5), (5, "y", 4, None), (None, "z", None, None)]
    assert asof_join(a.limit(0), b, "t", right_at="at").count() == 0
    assert [r["right_at"] for r in asof_join(a, b.limit(0), "t", right_at="at").collect()] == [None] * 3


@pytest.mark.parametrize("name", ["events_in_windows", "overlapping_orders", "last_click_before", "nearest_of_type"])
def test_ordered_queries_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    same(got.collect(), want)
    assert len(want) > 10 and "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_hot_keys_are_cut(spark):
    """A third of all rows under one key, most of them at one place, in many pieces."""
    a = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 2 == 0, 50).otherwise(F.col("id")).alias("t"), "id")
    b = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") * 2).alias("t"), F.col("id").alias("v"))
    whole = asof_join(a, b, "t", ["k"]).collect()
    same(asof_join(a, b, "t", ["k"], piece_rows=50).collect(), map(tuple, whole))
