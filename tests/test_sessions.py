"""Sessions as a stream: as the batch, rows in any order, late rows, state that ends."""

import datetime as dt
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from sqlloom.streaming.sessions import Sessions, run_to_end, sessions
from sqlloom.streaming.verdicts import read_log

DDL = "ts timestamp, who string, value double"
T0 = dt.datetime(2024, 1, 10)


def put(spark, folder, k, rows):
    spark.createDataFrame([(T0 + dt.timedelta(minutes=m), w, v) for m, w, v in rows], DDL).coalesce(1).write.parquet(f"{folder}/part{k}")
    os.makedirs(f"{folder}/log", exist_ok=True)
    for f in os.listdir(f"{folder}/part{k}"):
        if f.endswith(".parquet"):
            os.rename(f"{folder}/part{k}/{f}", f"{folder}/log/{k}-{f}")


def run(spark, folder):
    log = read_log(spark, f"file://{folder}/log", spark.createDataFrame([], DDL).schema)
    run_to_end(sessions(log, "who", "ts", "value", 1800), f"file://{folder}/out", f"file://{folder}/state")
    return {(r["key"], int((r["started"] - T0).total_seconds() // 60), int((r["ended"] - T0).total_seconds() // 60), r["n"], r["mean"]) for r in spark.read.parquet(f"file://{folder}/out").collect()}


def as_batch(spark, rows):
    d = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), w, v) for m, w, v in rows], DDL)
    return {(r["key"], int((r["started"] - T0).total_seconds() // 60), int((r["ended"] - T0).total_seconds() // 60), r["n"], r["mean"]) for r in sessions(d, "who", "ts", "value", 1800).collect()}


def test_stream_as_batch(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path)
    first = [(rng.randrange(0, 400), "abc"[rng.randrange(3)], float(rng.randrange(9))) for _ in range(60)]
    second = [(rng.randrange(350, 700), "abc"[rng.randrange(3)], float(rng.randrange(9))) for _ in range(40)]  # some before the first's last ones, within the watermark
    odd = [(5, None, 1.0), (6, "a", None)]
    put(spark, folder, 0, first + odd)
    run(spark, folder)
    put(spark, folder, 1, second)
    run(spark, folder)
    # a late row, which would join sessions that have ended, and a row that moves the watermark past all
    put(spark, folder, 2, [(10_000, "z", 1.0)])
    run(spark, folder)
    put(spark, folder, 3, [(100, "a", 9.0), (20_000, "z", 2.0)])
    got = run(spark, folder)
    put(spark, folder, 4, [(20_001, "z", 2.0)])
    got = run(spark, folder)
    assert got == as_batch(spark, first + second) | {("z", 10_000, 10_000, 1, 1.0)}


def test_sessions_of_a_batch(spark):
    assert as_batch(spark, [(0, "a", 1.0), (29, "a", 2.0), (59, "a", 3.0), (59, "a", 3.0), (0, "b", 5.0)]) == {("a", 0, 29, 2, 1.5), ("a", 59, 59, 2, 3.0), ("b", 0, 0, 1, 5.0)}
    empty = spark.createDataFrame([], DDL)
    assert sessions(empty, "who", "ts", "value", 60).count() == 0 and sessions(empty.withColumn("n", F.lit(1)), "who", "ts", "value", 60).columns == ["key", "started", "ended", "n", "mean"]


def test_one_timer_for_each_key():
    calls, state = [], []

    class Handle:
        registerTimer = staticmethod(lambda t: calls.append(("set", t)))  # noqa: N815
        deleteTimer = staticmethod(lambda t: calls.append(("drop", t)))  # noqa: N815
        getListState = staticmethod(lambda *_: type("Open", (), {"get": lambda self: iter(state), "put": lambda self, x: state.__setitem__(slice(None), x), "clear": lambda self: state.clear()})())  # noqa: N815

    p = Sessions(10_000_000)
    p.init(Handle)
    at = [k * 60_000_000 for k in range(40)]  # 40 sessions, a minute apart
    assert list(p.handleInputRows(("a",), iter([pd.DataFrame({"us": at, "value": [1.0] * 40})]), None)) == []
    assert calls == [("set", 10_000)] and len(state) == 40
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 30 * 60_000})()
    out = pd.concat(p.handleExpiredTimer(("a",), now, type("Gone", (), {"getExpiryTimeInMs": lambda self: 10_000})()))
    # all that have ended by the watermark at once, and a timer for the next
    assert len(out) == 30 and len(state) == 10 and calls[1:] == [("set", 30 * 60_000 + 10_000)]
