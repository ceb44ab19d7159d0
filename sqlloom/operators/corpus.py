"""Building labelled corpora: dedupe, disjoint splits, quotas, policies.

Random choices are hashes of row contents and a seed (md5, so that other engines
agree), never of a row's place: results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import dedupe_key
from ..plans.stages import written


def draw(*parts: Column | str) -> Column:
    """A uniform text draw, 32 hex digits, from the given parts."""
    return F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def dedupe(rows: DataFrame, text: str, order: str) -> DataFrame:
    """For each dedupe key the row of the smallest ``order``; a partial aggregate, so copies fold before the shuffle."""
    first = F.min_by(F.struct(*(F.col(c) for c in rows.columns)), F.col(order))
    return rows.withColumn("_k", dedupe_key(F.col(text))).groupBy("_k").agg(first.alias("_r")).select("_r.*")


def without_seen(rows: DataFrame, seen: DataFrame, text: str, seen_text: str) -> DataFrame:
    """Rows whose key does not occur among the seen texts."""
    keys = seen.select(dedupe_key(F.col(seen_text)).alias("_seen")).distinct()
    return rows.withColumn("_k", dedupe_key(F.col(text))).join(keys, F.col("_k") == F.col("_seen"), "left_anti").drop("_k")


def split_by_group(rows: DataFrame, group: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """split = validation for max(1, round(share * groups)) groups in the order of their draws, else train; a group is never divided."""
    drawn = rows.select(group).distinct().withColumns({"_d": draw(F.lit(seed), F.col(group)), "_all": F.lit(1)})
    ranked = places(drawn, "_all", "_d", group)
    most = F.greatest(F.lit(1), F.round(F.col("_n") * share))
    # the count is one row
    marked = ranked.join(F.broadcast(ranked.groupBy("_all").agg(F.count("*").alias("_n"))), "_all").select(F.col(group).alias("_g"), F.when(F.col("place") <= most, "validation").otherwise("train").alias("split"))
    return rows.join(marked, rows[group].eqNullSafe(marked["_g"])).drop("_g")


def quota(rows: DataFrame, label: str, per_label: int, *identity: str, seed: int = 42) -> DataFrame:
    """``per_label`` rows of each label in the order of their draws (over-generate, then pick)."""
    rn = F.row_number().over(W.partitionBy(label).orderBy("_d", *identity))
    return rows.withColumn("_d", draw(F.lit(seed), *(F.col(c) for c in identity))).withColumn("pick", rn).filter(F.col("pick") <= per_label).drop("_d")


def source_cap(rows: DataFrame, source: str, most: int, *identity: str, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each source."""
    return quota(rows, source, most, *identity, seed=seed)


def places(rows: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """rows with ``place``, from 1, in each group by the order given (which must tell all rows of a group apart).

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks; each range numbers its own
    rows, and the counts of the ranges before, one row for each group and range, are added.
    """
    spark, n = rows.sparkSession, len(order)
    keyed = rows.select("*", *((F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [f"_o{i}" for i in range(n)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(keyed.repartitionByRange(parts, group, *keys).withColumn("_part", F.spark_partition_id()), "places")
    counts = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_g", "_p", before.alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_part", group).orderBy(*keys)))
    numbered = own.join(offsets, (own["_part"] == offsets["_p"]) & own[group].eqNullSafe(offsets["_g"]))
    return numbered.select(*rows.columns, (F.col("_own") + F.col("_before")).cast("int").alias("place"))


def numbered_ids(rows: DataFrame, split: str, *order: str) -> DataFrame:
    """id = <split>-00000 and up within each split."""
    return places(rows, split, *order).withColumn("id", F.format_string("%s-%05d", F.col(split), F.col("place") - 1)).drop("place")


def length_batches(rows: DataFrame, text: str, partitions: int) -> DataFrame:
    """Rows of like length together, each partition sorted: batches with little padding."""
    return rows.withColumn("_n", F.length(text)).repartitionByRange(partitions, "_n").sortWithinPartitions("_n").drop("_n")


def policy_rows(queries: DataFrame, catalog: DataFrame, seed: int = 42) -> DataFrame:
    """Each query with an access policy; by a draw, it restricts a table the query names (PERMISSION_DENIED) or one that it does not (CORRECT).

    queries: db_id, sql, label, tables array; catalog: db_id, table_name.
    """
    q = queries.withColumn("_violate", F.conv(F.substring(draw(F.lit(seed), "sql"), 1, 1), 16, 10).cast("int") % 2 == 0)
    t = q.join(catalog.select("db_id", F.lower("table_name").alias("table_name")).distinct(), "db_id")
    uses = F.array_contains("tables", F.col("table_name"))
    best = F.min_by("table_name", F.when(uses == F.col("_violate"), draw(F.lit(seed), "table_name", "sql")))
    out = t.groupBy("db_id", "sql", "label", "_violate").agg(best.alias("restricted"))
    return out.filter("restricted is not null").select(
        "db_id", "sql", F.when(F.col("_violate"), "PERMISSION_DENIED").otherwise(F.col("label")).alias("label"),
        F.struct(F.array("restricted").alias("restricted_tables"), F.array().cast("array<string>").alias("restricted_columns")).alias("policy"),
    )


def weighted_order(options: DataFrame, group: str, weight: str, *identity: str, seed: int = 42) -> DataFrame:
    """place: the order of weighted draws without replacement within each group, by keys -ln(u) / weight."""
    u = (F.conv(F.substring(draw(F.lit(seed), *(F.col(c) for c in identity)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return places(options.withColumn("_key", -F.log(u) / F.col(weight)), group, "_key", *identity).drop("_key")
