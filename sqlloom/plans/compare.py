"""Comparing query results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import written


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, and the rows that one side has more often than the other: one aggregate over both."""
    columns = a.columns
    both = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    n = both.groupBy(*columns).agg(F.sum("_d").alias("_n")).filter("_n <> 0")
    return n.withColumn("_k", F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int")))).select(F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), *columns)


def positioned(rows: DataFrame) -> DataFrame:
    """rows with ``_at``, their place in the result's order: places within partitions, plus one count for each partition before."""
    kept = written(rows.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    counts = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(before), "_p").withColumn("_at", F.col("_before") + F.expr("_m & 8589934591")).select(*rows.columns, "_at")


def same_result(gold: DataFrame, got: DataFrame, gold_sql: str = "") -> bool:
    """Equal rows as multisets; in order too where the gold query says ``order by``.  Types count: 1 is not 1.0."""
    if len(gold.columns) != len(got.columns) or [f.dataType for f in gold.schema] != [f.dataType for f in got.schema]:
        return False
    names = [f"c{i}" for i in range(len(gold.columns))]
    a, b = gold.toDF(*names), got.toDF(*names)
    if re.search(r"order\s+by", gold_sql, re.I):
        a, b = positioned(a), positioned(b)
    return multiset_diff(a, b).isEmpty()
