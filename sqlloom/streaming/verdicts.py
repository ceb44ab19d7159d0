"""Counts of verdicts over a query log as a stream: an extension, with the same code as for batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, or of the one file at ``path``."""
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def class_counts(rows: DataFrame, at: str, label: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, label, n, mean_ms by event-time window; on a stream, rows later than ``late`` are left out once their window has closed."""
    t = rows.withWatermark(at, late) if rows.isStreaming else rows
    return t.groupBy(F.window(at, width), F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_ms")).select(F.col("window.start").alias("window_start"), "label", "n", F.round("mean_ms", 6).alias("mean_ms"))


def start_to_path(counts: DataFrame, path: str, checkpoint: str):
    """Starts the stream; each batch leaves the counts that it changed, and ``read_counts`` reads the last of each window.

    In update mode the watermark holds: rows that are later than it are left out, and a window's state ends with it.
    A batch that is repeated writes its own part again.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """window_start, label, n, mean_ms: the counts so far, by the last batch that changed each."""
    last = F.max_by(F.struct("n", "mean_ms"), "batch").alias("_c")
    return spark.read.parquet(path).groupBy("window_start", "label").agg(last).select("window_start", "label", "_c.n", "_c.mean_ms")
