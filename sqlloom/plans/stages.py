"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset, a temporary folder for a local master; on a cluster an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sqlloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def discard(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def interpreted(spark: SparkSession):
    """Without generated code for whole stages while small tables go through very large expressions, which take longer to compile than to run."""
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out over all cores: a small file is one task, however much is made of its rows later."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes df into the shared folder and reads it again."""
    spark = df.sparkSession
    path = os.path.join(folder(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
