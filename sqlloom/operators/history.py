"""History and saved schemas as tables: search pages, pruning, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import discard, written

KEPT, TITLE_CHARS, RESULT_BYTES = 500, 4000, 512 * 1024


def search(history: DataFrame, text: str, kind: str | None = None, client: str | None = None) -> DataFrame:
    """Rows whose title or class contains ``text``, ASCII letters in either case; ``% _`` stand for themselves."""
    like = lambda c: F.lower(F.col(c)).contains(text.lower())
    found = history.filter(like("title") | F.coalesce(like("error_class"), F.lit(False)))
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    return found if client is None else found.filter(F.col("client_id") == client)


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page; limit 1 to 200, offset from 0."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200, offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def newest(rows: DataFrame, key: str, at: str, tie: str, most: int = KEPT) -> DataFrame:
    """The newest ``most`` rows of each key.  row_number <= constant lets Spark cut each partition before the shuffle."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return rows.withColumn("rn", rn).filter(F.col("rn") <= most)


def storable(rows: DataFrame) -> DataFrame:
    """Titles cut, results over the limit dropped."""
    return rows.withColumns({"title": F.substring("title", 1, TITLE_CHARS), "result": F.when(F.octet_length("result") <= RESULT_BYTES, F.col("result"))})


def upsert(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """The table with rows of equal keys replaced; changes carry ``deleted``."""
    rest = table.join(changes.select(*keys), list(keys), "left_anti")
    return rest.unionByName(changes.filter(~F.col("deleted")).select(*table.columns))


def _part(keys: tuple[str, ...], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def store(rows: DataFrame, path: str, *keys: str, parts: int = 256) -> None:
    """A table that ``upsert_into`` can change: split by the hash of its keys into ``parts`` folders."""
    rows.withColumn("_part", _part(keys, parts)).repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_part").parquet(path)


def upsert_into(path: str, changes: DataFrame, *keys: str, parts: int = 256) -> list[int]:
    """Replaces, adds and removes (``deleted``) rows of a stored table; the parts that were rewritten.

    Only parts that hold a changed key are read and written; no other file is touched.  Keys are not null and occur
    once in changes and table.  The new parts are first written beside the table, so a failure before the last step leaves
    it as it was, and the same call again gives the same table.  The driver sees at most ``parts`` numbers.
    """
    spark = changes.sparkSession
    changes = changes.withColumn("_part", _part(keys, parts))
    touched = sorted(r[0] for r in changes.select("_part").distinct().collect())
    if not touched:
        return touched
    old = spark.read.parquet(path).filter(F.col("_part").isin(touched))
    new = written(upsert(old, changes, *keys), "upsert")
    new.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    # a part that has lost its last row is not overwritten: its folder goes
    left = {r[0] for r in new.select("_part").distinct().collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for k in set(touched) - left:
        at = hadoop(f"{path}/_part={k}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    discard(new)
    return touched


def total_requests(counters: DataFrame) -> DataFrame:
    """All requests of all endpoints."""
    return counters.agg(F.sum("requests").alias("requests"))


def service_counters(rows: DataFrame) -> DataFrame:
    """Requests, errors and the mean latency by endpoint."""
    return rows.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("error_class") != "CORRECT").alias("errors"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"))
