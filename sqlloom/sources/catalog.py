"""Schemas as a catalog table, from JSON, SQLite files, DDL, and information_schema rows.

catalog: db_id, table_name, columns array<struct<name, type, raw_type>>, primary_keys, foreign_keys.
"""

from __future__ import annotations

import json
import sqlite3
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_type

RAW = "db_id string, table_name string, columns array<struct<name string, raw_type string>>, primary_keys array<string>, foreign_keys array<struct<column string, target_table string, target_column string>>"


def typed(raw: DataFrame) -> DataFrame:
    """Adds the coarse type to each column."""
    return raw.withColumn("columns", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), normalize_type(c["raw_type"]).alias("type"), c["raw_type"].alias("raw_type"))))


def from_wire(spark: SparkSession, db_id: str, wire: dict) -> DataFrame:
    """A schema in wire form: columns as a dict, a list of dicts, a list of names, or the bare list."""
    rows = []
    for table, spec in wire.items():
        columns = spec.get("columns", spec) if isinstance(spec, dict) else spec
        pairs = columns.items() if isinstance(columns, dict) else [(c["name"], c.get("type", "")) if isinstance(c, dict) else (c, "") for c in columns]
        more = spec if isinstance(spec, dict) and "columns" in spec else {}
        links = [(k["column"], k["target_table"], k["target_column"]) for k in more.get("foreign_keys", [])]
        rows.append((db_id, table, [(n, t or "") for n, t in pairs], list(more.get("primary_keys", [])), links))
    return typed(spark.createDataFrame(rows, RAW))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON lines registry of rows in the catalog's raw form."""
    return typed(spark.read.schema(RAW).json(path))


def read_spider_tables(spark: SparkSession, path: str) -> DataFrame:
    """A tables.json file: parallel arrays of names, types and key positions."""
    t = spark.read.option("multiLine", True).json(path)
    pos = F.posexplode("table_names_original").alias("_i", "table_name")
    cols = F.arrays_zip(F.col("column_names_original").alias("c"), F.col("column_types").alias("t"))
    t = t.withColumn("_c", cols).select("*", pos)
    at = lambda x: F.element_at(x, 1).cast("int")
    name = lambda k: F.element_at(F.col("column_names_original")[k], 2)
    table_of = lambda k: F.col("table_names_original")[F.element_at(F.col("column_names_original")[k], 1).cast("int")]
    own = F.transform(F.filter("_c", lambda x: at(x["c"]) == F.col("_i")), lambda x: F.struct(F.element_at(x["c"], 2).alias("name"), x["t"].alias("raw_type")))
    keys = F.transform(F.filter("primary_keys", lambda k: at(F.col("column_names_original")[k.cast("int")]) == F.col("_i")), lambda k: name(k.cast("int")))
    links = F.transform(
        F.filter("foreign_keys", lambda k: at(F.col("column_names_original")[k[0].cast("int")]) == F.col("_i")),
        lambda k: F.struct(name(k[0].cast("int")).alias("column"), table_of(k[1].cast("int")).alias("target_table"), name(k[1].cast("int")).alias("target_column")),
    )
    return typed(t.select("db_id", "table_name", own.alias("columns"), keys.alias("primary_keys"), links.alias("foreign_keys")))


def _introspect(db: sqlite3.Connection) -> list[tuple]:
    out = []
    q = lambda s: '"' + s.replace('"', '""') + '"'
    for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY rowid").fetchall():
        info = db.execute(f"PRAGMA table_info({q(table)})").fetchall()
        links = [(k[3], k[2], k[4] or "") for k in db.execute(f"PRAGMA foreign_key_list({q(table)})").fetchall()]
        out.append((table, [(c[1], c[2] or "") for c in info], [c[1] for c in sorted(info, key=lambda c: c[5]) if c[5]], links))
    return out


def read_sqlite(spark: SparkSession, paths: str) -> DataFrame:
    """The schemas of SQLite files below a path, one task for each file; db_id is the file's name."""
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("db_id"), "content")

    def run(batches):
        for b in batches:
            for db_id, content in zip(b["db_id"].to_pylist(), b["content"].to_pylist(), strict=True):
                with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:
                    f.write(content)
                    f.flush()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    rows = [json.dumps({"db_id": db_id, "table_name": t, "columns": [dict(zip(("name", "raw_type"), c, strict=True)) for c in cols], "primary_keys": pk, "foreign_keys": [dict(zip(("column", "target_table", "target_column"), k, strict=True)) for k in fk]}) for t, cols, pk, fk in _introspect(db)]
                    db.close()
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["j"])

    return typed(files.mapInArrow(run, "j string").select(F.from_json("j", RAW).alias("r")).select("r.*"))


def from_ddl(ddl: DataFrame) -> DataFrame:
    """The catalog of rows (db_id, ddl): each script is run in SQLite in memory and introspected; declared types stay as written."""

    def run(batches):
        for b in batches:
            for db_id, script in zip(b["db_id"].to_pylist(), b["ddl"].to_pylist(), strict=True):
                db = sqlite3.connect(":memory:")
                db.executescript(script)
                rows = [json.dumps({"db_id": db_id, "table_name": t, "columns": [dict(zip(("name", "raw_type"), c, strict=True)) for c in cols], "primary_keys": pk, "foreign_keys": [dict(zip(("column", "target_table", "target_column"), k, strict=True)) for k in fk]}) for t, cols, pk, fk in _introspect(db)]
                db.close()
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["j"])

    return typed(ddl.select("db_id", "ddl").mapInArrow(run, "j string").select(F.from_json("j", RAW).alias("r")).select("r.*"))


def fold_information_schema(columns: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """The catalog from information_schema rows.

    columns: db_id, table_name, column_name, data_type, ordinal; keys: db_id, table_name,
    column_name, ordinal; links: db_id, table_name, column_name, target_table, target_column, ordinal.
    """
    k = ["db_id", "table_name"]
    c = columns.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type"))), lambda x: F.struct(x["column_name"].alias("name"), x["data_type"].alias("raw_type"))).alias("columns"))
    p = keys.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]).alias("primary_keys"))
    f = links.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "target_table", "target_column"))), lambda x: F.struct(x["column_name"].alias("column"), x["target_table"].alias("target_table"), x["target_column"].alias("target_column"))).alias("foreign_keys"))
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    t = c.join(p, k, "left").join(f, k, "left")
    return typed(t.select(*k, "columns", empty("primary_keys", "array<string>"), empty("foreign_keys", "array<struct<column string, target_table string, target_column string>>")))


def read_jdbc(spark: SparkSession, url: str, dialect: str, **options) -> DataFrame:
    """The catalog of a live PostgreSQL or MySQL database; the joins of the constraint views run there."""
    schema = "current_schema()" if dialect == "postgresql" else "database()"
    read = lambda q: spark.read.format("jdbc").options(url=url, query=q, **options).load()
    columns = read(f"SELECT table_name, column_name, data_type, ordinal_position AS ordinal FROM information_schema.columns WHERE table_schema = {schema}")
    usage = f"SELECT t.constraint_type, k.table_name, k.column_name, k.ordinal_position AS ordinal, %s FROM information_schema.table_constraints t JOIN information_schema.key_column_usage k ON k.constraint_name = t.constraint_name AND k.constraint_schema = t.constraint_schema AND k.table_name = t.table_name %s WHERE t.table_schema = {schema} AND t.constraint_type = '%s'"
    keys = read(usage % ("1 AS one", "", "PRIMARY KEY"))
    if dialect == "postgresql":
        # the referenced column of the same place in its key, so composite keys do not multiply
        links = read(usage % ("r.table_name AS target_table, r.column_name AS target_column", "JOIN information_schema.referential_constraints c ON c.constraint_name = t.constraint_name AND c.constraint_schema = t.constraint_schema JOIN information_schema.key_column_usage r ON r.constraint_name = c.unique_constraint_name AND r.constraint_schema = c.unique_constraint_schema AND r.ordinal_position = k.position_in_unique_constraint", "FOREIGN KEY"))
    else:
        links = read(usage % ("k.referenced_table_name AS target_table, k.referenced_column_name AS target_column", "", "FOREIGN KEY"))
    mark = lambda df: df.withColumn("db_id", F.lit(url.rsplit("/", 1)[-1]))
    return fold_information_schema(mark(columns), mark(keys), mark(links))


def checked(catalog: DataFrame, most: int = 2000) -> DataFrame:
    """The catalog, failing where a database has no or too many tables, or a table no columns."""
    n = catalog.groupBy("db_id").agg(F.count("*").alias("_n"), F.min(F.size("columns")).alias("_c"))
    bad = F.when((F.col("_n") > most) | (F.col("_c") < 1), F.raise_error(F.concat(F.lit("invalid schema: "), F.col("db_id"))))
    return catalog.join(n.withColumn("_bad", bad), "db_id").filter(F.col("_bad").isNull()).drop("_n", "_c", "_bad")


def sizes(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("db_id").agg(F.count("*").alias("tables"), F.sum(F.size("columns")).alias("columns"))
