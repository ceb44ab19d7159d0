"""Counts over a log as a stream: late rows, state, batches."""

import datetime as dt
import os

from sqlloom.streaming.verdicts import class_counts, read_counts, read_log, start_to_path

DDL = "ts timestamp, event_type string, value double"
DAY = dt.datetime(2024, 1, 10)


def put(spark, folder, k, rows):
    spark.createDataFrame([(DAY + dt.timedelta(hours=h), e, v) for h, e, v in rows], DDL).coalesce(1).write.parquet(f"{folder}/part{k}")
    for f in os.listdir(f"{folder}/part{k}"):
        if f.endswith(".parquet"):
            os.makedirs(f"{folder}/log", exist_ok=True)
            os.rename(f"{folder}/part{k}/{f}", f"{folder}/log/{k}-{f}")


def run(spark, folder):
    log = read_log(spark, f"file://{folder}/log", spark.createDataFrame([], DDL).schema)
    q = start_to_path(class_counts(log, "ts", "event_type"), f"file://{folder}/table", f"file://{folder}/checkpoint")
    q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def counts(spark, folder):
    return {(int((r["window_start"] - DAY).total_seconds() // 3600), r["label"]): (r["n"], r["mean_ms"]) for r in read_counts(spark, f"file://{folder}/table").collect()}


def test_late_rows_are_left_out_and_state_ends(spark, tmp_path):
    put(spark, tmp_path, 0, [(0, "a", 1.0), (0.5, "a", 3.0), (1, "b", 5.0)])
    run(spark, tmp_path)
    assert counts(spark, tmp_path) == {(0, "a"): (2, 2.0), (1, "b"): (1, 5.0)}
    put(spark, tmp_path, 1, [(2, "a", 7.0), (1.2, "b", 7.0)])
    run(spark, tmp_path)
    assert counts(spark, tmp_path) == {(0, "a"): (2, 2.0), (1, "b"): (2, 6.0), (2, "a"): (1, 7.0)}
    put(spark, tmp_path, 2, [(9 * 24, "a", 1.0)])
    assert run(spark, tmp_path) <= 4
    # nine days late: the windows of the first day are closed, their state is gone
    put(spark, tmp_path, 3, [(0.1, "a", 100.0), (9 * 24 + 0.2, "a", 3.0)])
    assert run(spark, tmp_path) == 1
    got = counts(spark, tmp_path)
    assert got[0, "a"] == (2, 2.0) and got[9 * 24, "a"] == (2, 2.0) and len(got) == 4
    rows = [(0, "a", 1.0), (0.5, "a", 3.0), (1, "b", 5.0), (2, "a", 7.0), (1.2, "b", 7.0), (216, "a", 1.0), (216.2, "a", 3.0)]
    batch = class_counts(spark.createDataFrame([(DAY + dt.timedelta(hours=h), e, v) for h, e, v in rows], DDL), "ts", "event_type")
    assert {(int((r["window_start"] - DAY).total_seconds() // 3600), r["label"]): (r["n"], r["mean_ms"]) for r in batch.collect()} == got
