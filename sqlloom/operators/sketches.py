"""Mergeable sketches by day: distinct counts and quantiles of any span of days without reading its rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches, and what holds for results of these sizes: five standard errors of a distinct count, and of a rank.
LOG_REGISTERS, QUANTILE_K = 13, 1600
DISTINCT_ERROR, RANK_ERROR = 5 * 1.04 / 2 ** (LOG_REGISTERS / 2), 0.01


def by_day(rows: DataFrame, at: str, group: Sequence[str], distinct: str, value: str) -> DataFrame:
    """day, the group's columns, n, distinct_sketch, value_sketch.  Null values are left out of the sketches, not of n.

    Both sketches are partial aggregates: tasks send a few kilobytes for each day and group, whatever the rows.
    """
    return rows.groupBy(F.to_date(at).alias("day"), *group).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, LOG_REGISTERS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_K).alias("value_sketch")
    )


def store(sketches: DataFrame, path: str) -> None:
    """Writes sketches by day.  A day that is written again replaces itself; other days stay."""
    sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged(sketches: DataFrame, group: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """The group's columns, n, distinct, quantiles (array; null without values) over all days given."""
    both = sketches.groupBy(*group).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"), F.kll_merge_agg_double("value_sketch").alias("_v"))
    some = F.kll_sketch_get_n_double("_v") > 0
    return both.select(*group, "n", "distinct", F.when(some, F.array(*(F.kll_sketch_get_quantile_double("_v", F.lit(float(q))) for q in quantiles))).alias("quantiles"))
