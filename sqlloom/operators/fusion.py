"""Fusing an analyzer's verdict with a model's, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8


def fuse(threshold: float = THRESHOLD) -> Column:
    """struct<error_class, confidence, decided_by, note> from analyzer_class, schema_checked, model_class, model_confidence, model_correct.

    An error that the analyzer found stands.  A query that was checked against a schema is
    correct.  Without a schema, a confident model decides.
    """
    a, m, c = F.col("analyzer_class"), F.col("model_class"), F.col("model_confidence")
    wrong, sure = a != "CORRECT", F.coalesce((F.col("model_class") != "CORRECT") & (c >= threshold), F.lit(False))
    agree = F.coalesce(m == a, F.lit(False))
    alone = ~wrong & ~F.col("schema_checked") & sure
    note = (
        F.when(wrong & m.isNotNull() & ~agree & (a != "PERMISSION_DENIED"), "model disagrees; the verified finding takes precedence")
        .when(~wrong & F.col("schema_checked") & sure, "model suspects an error; the query compiles and passes every rule")
        .when(alone, "decided by the model alone; unverified")
        .when(~wrong & ~F.col("schema_checked"), "no schema: tables, columns and types were not checked")
    )
    return F.struct(
        F.when(wrong, a).when(alone, m).otherwise("CORRECT").alias("error_class"),
        F.when(wrong | F.col("schema_checked") | m.isNull(), 1.0).when(alone, c).otherwise(F.coalesce(F.col("model_correct"), F.lit(1.0))).alias("confidence"),
        F.when(alone, "model").when(agree & (wrong | F.col("schema_checked")), "analyzer+model").otherwise("analyzer").alias("decided_by"),
        note.alias("note"),
    )


def summary(diagnoses: DataFrame) -> DataFrame:
    """total, errors, repaired of a batch."""
    return diagnoses.agg(F.count("*").alias("total"), F.count_if(F.col("error_class") != "CORRECT").alias("errors"), F.count_if(F.coalesce(F.col("repaired"), F.lit(False))).alias("repaired"))
