"""The candidate loop from questions to SQL: check all, take the first correct, else repair the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_sql
from .diagnose import diagnose
from .repair import repair


def answer(questions: DataFrame, generated: DataFrame, catalog: DataFrame) -> DataFrame:
    """question_id, sql, status from questions (question_id, db_id) and generated answers (question_id, rank, answer).

    status: valid (the first candidate), valid_alternative, repaired, invalid, no_candidate.
    """
    c = generated.join(questions, "question_id").withColumn("sql", extract_sql(F.col("answer"))).filter("sql <> ''")
    c = c.groupBy("question_id", "db_id", F.lower("sql").alias("_k")).agg(F.min(F.struct("rank", "sql")).alias("_m")).select("question_id", "db_id", "_m.rank", "_m.sql")
    d = diagnose(c.withColumn("id", F.xxhash64("question_id", "rank")), catalog)
    best = d.groupBy("question_id", "db_id").agg(
        F.min_by(F.struct("rank", "sql"), F.when(F.col("error_class") == "CORRECT", F.col("rank"))).alias("right"), F.min(F.struct("rank", "sql")).alias("first")
    )
    fixed = repair(best.filter("right is null").select(F.col("question_id").alias("id"), "db_id", F.col("first.sql").alias("sql")), catalog).select(F.col("id").alias("question_id"), "repaired_query", "success")
    j = questions.join(best.drop("db_id"), "question_id", "left").join(fixed, "question_id", "left")
    status = F.when(F.col("right").isNotNull(), F.when(F.col("right.rank") == F.col("first.rank"), "valid").otherwise("valid_alternative")).when(F.col("first").isNull(), "no_candidate").when(F.col("success"), "repaired").otherwise("invalid")
    sql = F.when(F.col("right").isNotNull(), F.col("right.sql")).when(F.col("success"), F.col("repaired_query")).otherwise(F.col("first.sql"))
    return j.select("question_id", "db_id", sql.alias("sql"), status.alias("status"))
