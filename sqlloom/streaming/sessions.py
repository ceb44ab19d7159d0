"""Sessions of a log with running means, as a stream with state and timers: an extension, with the same result as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Needed by stateful processors.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN = "first_us bigint, last_us bigint, n bigint, total double"
CLOSED = "key string, started timestamp, ended timestamp, n bigint, mean double"


def _ended(key: str, s: tuple) -> dict:
    return {"key": key, "started": pd.Timestamp(s[0], unit="us", tz="UTC"), "ended": pd.Timestamp(s[1], unit="us", tz="UTC"), "n": s[2], "mean": round(s[3] / s[2], 6)}


class Sessions(StatefulProcessor):
    """Open sessions of one key: first and last time, rows, sum of values.

    Rows may come in any order within the watermark; one that lies between two open sessions, within the gap of both,
    joins them.  A session is given out, and its state dropped, by a timer once the watermark is a gap past its last row:
    no row that is still taken can belong to it then.  So state is bounded by the sessions within gap and lateness.

    A key has one timer, for the session that ends first; when it goes off, all that have ended by the watermark are given
    out.  Each call of the state store is a round trip, so their number grows with the keys of a batch, not with the sessions.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", OPEN)

    def _timer(self, s: tuple) -> int:
        return -(-(s[1] + self.gap) // 1000)

    def _joined(self, pieces: list[tuple]) -> list[tuple]:
        merged: list[tuple] = []
        for p in sorted(pieces):
            if merged and p[0] - merged[-1][1] < self.gap:
                a = merged[-1]
                merged[-1] = (a[0], max(a[1], p[1]), a[2] + p[2], a[3] + p[3])
            else:
                merged.append(p)
        return merged

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = [tuple(s) for s in self.open.get()]
        merged = list(had)
        for batch in rows:  # a batch at a time, so what is held are open sessions and one batch
            merged = self._joined(merged + [(int(t), int(t), 1, float(v)) for t, v in zip(batch["us"], batch["value"], strict=True)])
        self._set_timer(had, merged)
        self.open.put(merged)
        yield from ()

    def _set_timer(self, had: list[tuple], now: list[tuple]) -> None:
        before, after = (min(map(self._timer, x), default=None) for x in (had, now))
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the timer that goes off is dropped by itself
        at, kept, done = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), [], []
        for s in map(tuple, self.open.get()):
            (done if self._timer(s) <= at else kept).append(s)
        if kept:
            self.open.put(kept)
            self.handle.registerTimer(min(map(self._timer, kept)))
        else:
            self.open.clear()
        if done:
            yield pd.DataFrame([_ended(key[0], s) for s in done])

    def close(self) -> None:
        pass


def sessions(rows: DataFrame, key: str, at: str, value: str, gap_seconds: int, late: str = "2 hours") -> DataFrame:
    """key, started, ended, n, mean: runs of a key's rows with less than ``gap_seconds`` from each to the next.

    A stream gives each session once, when it has ended; rows later than ``late`` are left out; it needs the state
    store ``ROCKSDB``.  A key's rows of a micro-batch go to one task, in Arrow batches.  A batch gives all.  Rows without key, time or value are left out.  Times are kept to the microsecond.
    """
    t = rows.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).filter("key is not null and at is not null and value is not null")
    t = t.withColumn("us", F.unix_micros("at"))
    gap = gap_seconds * 1_000_000
    if rows.isStreaming:
        return t.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Sessions(gap), outputStructType=CLOSED, outputMode="append", timeMode="eventTime")
    w = W.partitionBy("key").orderBy("us")
    begins = F.coalesce((F.col("us") - F.lag("us").over(w) >= gap).cast("int"), F.lit(1))
    numbered = t.withColumn("_b", begins).withColumn("_s", F.sum("_b").over(w))
    return numbered.groupBy("key", "_s").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).drop("_s")


def run_to_end(closed: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over what there is; sessions that have ended by then are in ``path``.  The caller's state store setting stays as it was."""
    conf, key = closed.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKSDB)
    try:
        closed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(key, before)
