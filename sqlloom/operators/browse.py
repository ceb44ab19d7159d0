"""What pages and services ask of verdicts, catalogs, histories and jobs: filters, projections, orders, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import draw

#: The form of a client's id, the longest query of a single request, and how long a finished job is shown.
CLIENT_ID = r"^[A-Za-z0-9_-]{8,64}$"
MOST_CHARS, JOB_SECONDS = 20_000, 3600


def batch_filter(rows: DataFrame, show: str = "ALL", text: str = "") -> DataFrame:
    """Rows of a batch (sql, error_class, issues): all, ERRORS or one class, whose query or any issue holds a text in any case."""
    of_class = F.lit(True) if show == "ALL" else F.col("error_class") != "CORRECT" if show == "ERRORS" else F.col("error_class") == show
    holds = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return rows.filter(of_class & (holds(F.col("sql")) | F.exists("issues", lambda x: holds(x["message"])) if text else F.lit(True)))


def databases_named(catalog: DataFrame, text: str) -> DataFrame:
    """db_id of databases whose name holds a text, in any case."""
    return catalog.filter(F.contains(F.lower("db_id"), F.lit(text.lower()))).select("db_id").distinct()


def tables_named(catalog: DataFrame, text: str) -> DataFrame:
    """Tables whose name, or any column's name, holds a text, in any case."""
    holds = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return catalog.filter(holds(F.col("table_name")) | F.exists("columns", lambda c: holds(c["name"])))


def executable(databases: DataFrame, files: DataFrame) -> DataFrame:
    """Databases (db_id, path) whose file is among ``files`` (path), as a listing of the store gives them."""
    return databases.join(files.select("path").distinct(), "path", "left_semi")


def toggled(closed: Column, name: Column) -> Column:
    """A policy's list with a name added, or removed where it is in."""
    closed = F.coalesce(closed, F.array().cast("array<string>"))
    return F.when(F.array_contains(closed, name), F.array_remove(closed, name)).otherwise(F.array_append(closed, name))


def acceptable(sql: Column, client: Column) -> Column:
    """Whether a single request has a well-formed client id and a query of fitting length."""
    return F.coalesce(client.rlike(CLIENT_ID) & F.length(sql).between(1, MOST_CHARS), F.lit(False))


def context_of(inline: str, schema_id: str, db_id: str) -> Column:
    """Where a request's schema comes from: an inline schema before a saved one before a known database."""
    return F.when(F.col(inline).isNotNull(), F.struct(F.lit("inline").alias("kind"), F.col(inline).alias("value"))).when(F.col(schema_id).isNotNull(), F.struct(F.lit("saved").alias("kind"), F.col(schema_id).cast("string").alias("value"))).when(
        F.col(db_id).isNotNull(), F.struct(F.lit("database").alias("kind"), F.col(db_id).alias("value"))
    )


def history_rows(history: DataFrame) -> DataFrame:
    """A history's rows as a list shows them: context and summary decoded from JSON, and whether there is a result."""
    decoded = lambda c: F.from_json(c, "map<string,string>")
    return history.select("id", "kind", "title", "error_class", "created_at", decoded("context").alias("context"), decoded("summary").alias("summary"), F.col("result").isNotNull().alias("has_result"))


def visible_jobs(jobs: DataFrame, owner: str, now: Column) -> DataFrame:
    """An owner's jobs that still run, or ended less than an hour before ``now`` (seconds)."""
    return jobs.filter((F.col("owner") == owner) & (F.col("ended_at").isNull() | (now - F.col("ended_at") < JOB_SECONDS)))


def subsample(rows: DataFrame, n: int, *identity: str, seed: int = 42) -> DataFrame:
    """n rows in an order drawn by the seed: a sampling operator, so the limit is its purpose."""
    return rows.withColumn("_d", draw(F.lit(seed), *identity)).orderBy("_d", *identity).limit(n).drop("_d")


def by_probability(probabilities: Column) -> Column:
    """array<struct<label, p>> of a map, the likeliest first, then by label."""
    listed = F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("label")))
    return F.transform(F.array_sort(listed), lambda e: F.struct(e["label"].alias("label"), (-e["p"]).alias("p")))


def strongest(weights: Column, n: int = 3) -> Column:
    """The n tokens of the largest absolute weights of array<struct<token, weight>>, then by token."""
    listed = F.transform(weights, lambda x: F.struct((-F.abs(x["weight"])).alias("w"), x["token"].alias("token")))
    return F.transform(F.slice(F.array_sort(listed), 1, n), lambda x: x["token"])


def ranked(candidates: DataFrame, column: str) -> DataFrame:
    """Each element of an array as a row, with its rank from 1."""
    rest = [c for c in candidates.columns if c != column]
    return candidates.select(*rest, F.posexplode(column).alias("_i", "candidate")).select(*rest, (F.col("_i") + 1).alias("rank"), "candidate")


def throughput(done: DataFrame, at: str) -> DataFrame:
    """n, seconds, per_second of rows with a time."""
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    return done.agg(F.count("*").alias("n"), F.round(seconds, 3).alias("seconds"), F.round(F.count("*") / F.nullif(seconds, F.lit(0.0)), 6).alias("per_second"))
