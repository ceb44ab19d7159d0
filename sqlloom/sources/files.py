"""Corpus files in and out."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, split string, db_id string, sql string, label string, source_sql string, mutation string, description string, issues array<string>"


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A JSON lines split of a corpus."""
    return spark.read.schema(CORPUS).json(path)


def read_queries_csv(spark: SparkSession, path: str, default_db: str | None = None) -> DataFrame:
    """query and db_id of an uploaded CSV file; a byte order mark is dropped, fields may hold line ends, ``query`` is required."""
    t = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    t = t.toDF(*(c.removeprefix("﻿").strip() for c in t.columns))
    if "query" not in t.columns:
        raise ValueError("the CSV file needs a column 'query'")
    own = F.col("db_id") if "db_id" in t.columns else F.lit(None).cast("string")
    return t.filter(F.col("query").isNotNull()).select("query", F.coalesce(F.nullif(own, F.lit("")), F.lit(default_db)).alias("db_id"))


def unknown_databases(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    return queries.filter("db_id is not null").select("db_id").distinct().join(catalog.select("db_id").distinct(), "db_id", "left_anti")


def read_spider(spark: SparkSession, path: str) -> DataFrame:
    """question, db_id, sql of a question file."""
    return spark.read.option("multiLine", True).json(path).select("question", "db_id", F.col("query").alias("sql"))


def write_jsonl(rows: DataFrame, path: str, split: str | None = "split") -> None:
    (rows.write.partitionBy(split) if split else rows.write).mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Arrays joined by '; ', other nested values as JSON, nulls empty."""
    flat = [F.array_join(f.name, "; ").alias(f.name) if f.dataType.simpleString().startswith("array<string") else F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").csv(path)


def write_schemas(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A Markdown report of tables, all rows, which reach the driver one partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        for title, df in tables.items():
            out.write(f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n")
            for r in df.toLocalIterator():
                out.write("| " + " | ".join("" if x is None else str(x) for x in r) + " |\n")
            out.write("\n")


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON object of arrays, all rows, which reach the driver one partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for i, (title, df) in enumerate(tables.items()):
            out.write(f"{',' if i else ''}\n{json.dumps(title)}: [")
            for k, r in enumerate(df.toLocalIterator()):
                out.write(("," if k else "") + "\n " + json.dumps(r.asDict(recursive=True), default=str))
            out.write("]")
        out.write("}\n")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written there first if it is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.parquet(path)
    return spark.read.parquet(path)
