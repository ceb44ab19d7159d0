"""The verdict classes as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Class ids, names, and the order in which a query's problems are reported (null: none).
CLASSES = (
    (0, "CORRECT", None),
    (1, "SYNTAX_ERROR", 0),
    (2, "UNKNOWN_TABLE", 1),
    (3, "UNKNOWN_COLUMN", 2),
    (4, "DATATYPE_MISMATCH", 5),
    (5, "AMBIGUOUS_REFERENCE", 3),
    (6, "PERMISSION_DENIED", 4),
    (7, "SEMANTIC_ERROR", 6),
)
NAMES = tuple(name for _, name, _ in CLASSES)
PRIORITY = {name: p for _, name, p in CLASSES if p is not None}


def labels_dim(spark: SparkSession) -> DataFrame:
    """id, label, priority: eight rows."""
    return spark.createDataFrame(list(CLASSES), "id int, label string, priority int")
