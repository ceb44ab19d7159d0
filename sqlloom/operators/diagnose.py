r"""Diagnosing SQL texts: a compile check, static rules and access policies over a corpus.

queries: id, db_id, sql, and optionally policy struct<restricted_tables, restricted_columns>.
catalog: see sources.catalog.

One Arrow pass gives two things for each query.  The compile check asks SQLite to EXPLAIN the
query on empty typed tables (it never runs it); that is the reference dialect.  A worker remembers
what it found for texts that differ only in the values that columns are compared with, and hands on
such texts of a batch as one row that holds theirs: rules are applied once to it, and the values are put into what they tell.
functions.scopes lists what each SELECT of the query says: sources, items, columns with the tables they resolve
to, grouping, comparisons, join predicates.  All rules are column expressions over these lists, SELECT by SELECT, nested
ones and those of set operations included.  Where a database is not in the catalog, the
tables that a query uses are made up from the query itself, so that grammar and rules
that need no types are still checked.

Schemas reach the tasks once (up to SHIPPED bytes of them; beyond that each query carries its own, sorted by database).
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from ..functions.built import built_once
from ..functions.scopes import LONGEST, MARK, SCOPE, Query, marked_places, meant, pattern_of, with_values
from ..functions.text import NUMERIC, normalize_query, quote_ident
from ..labels import PRIORITY

ISSUE = "struct<error_class string, code string, message string, token string, source string>"
#: How the engine's messages map to classes, first match first; anything else is SEMANTIC_ERROR.
ENGINE = (
    (r"syntax error|incomplete input|unrecognized token|unterminated|one statement at a time|should come after|not authorized", "SYNTAX_ERROR", "SYN_ENGINE"),
    (r"no such table: ", "UNKNOWN_TABLE", "TAB_UNKNOWN"),
    (r"no such column: ", "UNKNOWN_COLUMN", "COL_UNKNOWN"),
    (r"ambiguous column name: ", "AMBIGUOUS_REFERENCE", "AMB_COLUMN"),
    (r"no such function: ", "SEMANTIC_ERROR", "SEM_FUNCTION"),
    (r"wrong number of arguments", "SEMANTIC_ERROR", "SEM_ARGUMENTS"),
    (r"misuse of aggregate|misuse of window", "SEMANTIC_ERROR", "SEM_AGGREGATE"),
    (r"term out of range", "SEMANTIC_ERROR", "SEM_POSITION"),
    (r"same number of result columns", "SEMANTIC_ERROR", "SEM_SET_ARITY"),
    (r"sub-select returns|row value misused", "SEMANTIC_ERROR", "SEM_SUBQUERY_ARITY"),
    (r"HAVING clause", "SEMANTIC_ERROR", "SEM_HAVING"),
)
UNKNOWN_NAME = re.compile("no such (table|column)|ambiguous column", re.I)
FORBIDDEN = r"(?i)^\s*(attach|detach|pragma|vacuum|reindex|analyze)\b"
#: The type a column is declared with in the empty tables.
AFFINITY = {"number": " NUMERIC", "text": " TEXT", "time": " TEXT", "boolean": " BOOLEAN"}
#: Bytes of schemas that are sent to every task.
SHIPPED = 8 << 20
#: Rows that one row of ``compiled`` holds at most.
HELD = 1000
#: NUMERIC as Spark reads it: its $ also stands before one of these at the end.
NUMBER = re.compile(NUMERIC.removesuffix("$") + r"[\u0085\u2028\u2029]?\Z", re.A)


def scripts(catalog: DataFrame) -> DataFrame:
    """db_id, schema: as JSON, the script that makes empty typed tables, and each table's column types and primary keys in lower case."""
    kind = lambda c: F.coalesce(*(F.when(c["type"] == k, v) for k, v in AFFINITY.items()), F.lit(""))
    ddl = F.concat(F.lit("CREATE TABLE "), quote_ident(F.col("table_name")), F.lit(" ("), F.array_join(F.transform("columns", lambda c: F.concat(quote_ident(c["name"]), kind(c))), ", "), F.lit(")"))
    one = F.struct(
        ddl.alias("ddl"), F.lower("table_name").alias("t"), F.transform("columns", lambda c: F.struct(F.lower(c["name"]).alias("c"), c["type"].alias("k"))).alias("cols"),
        F.transform(F.coalesce("primary_keys", F.array().cast("array<string>")), F.lower).alias("keys"),
    )
    return catalog.groupBy("db_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("schema"))


@lru_cache(maxsize=512)
def _schema(text: str | None) -> tuple[sqlite3.Connection, dict, dict]:
    tables = json.loads(text or "[]")
    return _empty(";\n".join(t["ddl"] for t in tables)), {t["t"]: {c["c"]: c.get("k") for c in t["cols"]} for t in tables}, {t["t"]: t["keys"] for t in tables}


def _empty(ddl: str) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:", isolation_level=None)
    db.executescript(ddl)
    denied = {sqlite3.SQLITE_ATTACH, sqlite3.SQLITE_DETACH, sqlite3.SQLITE_PRAGMA}
    db.set_authorizer(lambda action, *_: sqlite3.SQLITE_DENY if action in denied else sqlite3.SQLITE_OK)
    return db


def _compile(db: sqlite3.Connection, sql: str) -> str | None:
    try:
        db.execute("EXPLAIN " + sql)
    except (sqlite3.Error, sqlite3.Warning, ValueError) as e:
        return str(e)
    return None


def _checked(schema: str | None, sql: str, restricted: bool) -> tuple[str | None, list, list]:
    """The engine's first message, the tables that the query names, and its SELECTs; the latter two only where rules look at them."""
    if found := pattern_of(sql):
        pattern, values = found
        if (known := _checked_pattern(schema, pattern, restricted)) is not None:
            error, named, scopes, places = known
            return error, named, with_values(scopes, places, values) if places else scopes
    return _checked_text(schema, sql, restricted)


@lru_cache(maxsize=8192)
def _checked_pattern(schema: str | None, pattern: str, restricted: bool) -> tuple[str | None, list, list, list] | None:
    """What texts of a pattern have in common, and where their values go; None where the engine's message tells a value."""
    error, named, scopes = _checked_text(schema, pattern, restricted)
    return None if error and MARK in error else (error, named, scopes, marked_places(scopes))


@lru_cache(maxsize=8192)
def _shared(schema: str | None, pattern: str, restricted: bool, odd: tuple[bool, ...]) -> tuple[str | None, list, list] | None:
    """What texts of a pattern tell, with marks for their values: after an underscore where ``odd``, as for strings that are no numbers.

    None where a value may do more than be told: in the engine's message, and in items and groups, which are compared with each other.
    """
    known = _checked_pattern(schema, pattern, restricted)
    if known is None or any(name != "compared" for _, name, *_ in known[3]):
        return None
    error, named, scopes, places = known
    return error, named, with_values(scopes, places, [f"{'_' * x}{MARK}{i:03d}" for i, x in enumerate(odd)])


def _alike(schema: str | None, sql: str, restricted: bool) -> tuple[tuple[str, tuple[bool, ...] | None], list[str] | None]:
    """What texts with the same facts have in common, and what the values mean in which they differ."""
    if found := pattern_of(sql):
        pattern, raw = found
        values = [meant(v) for v in raw]
        odd = tuple(r[0] == "'" and not NUMBER.match(v) for r, v in zip(raw, values, strict=True))
        if _shared(schema, pattern, restricted, odd) is not None:
            return (pattern, odd), values
    return (sql, None), None


def _checked_text(schema: str | None, sql: str, restricted: bool) -> tuple[str | None, list, list]:
    if schema is None:
        first = Query(sql, {}, {})
        tables, keys = first.synthetic(), {}
        db = _empty(";\n".join(f"CREATE TABLE {_quoted(t)} ({', '.join(map(_quoted, cols)) or 'rowid_'})" for t, cols in tables.items()))
    else:
        db, tables, keys = _schema(schema)
    error = _compile(db, sql)
    if schema is None:
        db.close()
    if error and not restricted and not (schema is None and UNKNOWN_NAME.search(error)):
        return error, [], []
    q = Query(sql, tables, keys)
    return error, q.named, q.scopes


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def compiled(queries: DataFrame, catalog: DataFrame, kept: list[str]) -> DataFrame:
    """queries: db_id, _q, _policy (JSON), and ``kept``.  A row for texts of a batch that have the same facts: _q of one of them, their _policy,
    schema_checked, engine_error (the engine's first message, or null), tables, scopes, and _rows: each text's kept columns and _values, which stand for the marks in scopes."""
    spark = queries.sparkSession
    schemas = scripts(catalog)
    size = schemas.agg(F.sum(F.length("schema") + 64)).first()[0] or 0
    shipped = {r["db_id"]: r["schema"] for r in schemas.collect()} if size <= SHIPPED else None
    if shipped is None:
        queries = queries.join(schemas, "db_id", "left").sortWithinPartitions("db_id")
    names = queries.columns
    scope = ArrayType(spark.createDataFrame([], f"s {SCOPE}").schema["s"].dataType)
    values = ArrayType(StringType())
    more = [("schema_checked", "boolean"), ("engine_error", "string"), ("tables", "array<string>")]
    types: list[DataType] = [spark.createDataFrame([], f"x {t}").schema["x"].dataType for _, t in more]
    held = ArrayType(StructType([*(queries.schema[c] for c in kept), StructField("_values", values)]))
    out = StructType([queries.schema["_q"], queries.schema["_policy"], *(StructField(n, t) for (n, _), t in zip(more, types, strict=True)), StructField("scopes", scope), StructField("_rows", held)])
    arrow = [to_arrow_type(t) for t in (*types, scope)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sqls, policies, own = (b.column(names.index(c)).to_numpy(zero_copy_only=False).tolist() for c in ("_q", "_policy", "schema" if shipped is None else "db_id"))
            own = own if shipped is None else [shipped.get(d) for d in own]
            groups, facts, told, last = [], [], [], {}
            for i, (d, s, p) in enumerate(zip(own, sqls, policies, strict=True)):
                like, v = _alike(d, s, p is not None)
                told.append(v)
                key = (d, p, *like) if len(s) <= LONGEST else i
                if len(group := last.get(key, ())) in (0, HELD):
                    last[key] = group = []
                    groups.append(group)
                    facts.append((d is not None, *(_checked(d, s, p is not None) if v is None else _shared(d, like[0], p is not None, like[1]))))
                group.append(i)
            order, first = pa.array([i for g in groups for i in g], pa.int32()), pa.array([g[0] for g in groups], pa.int32())
            rows = pa.StructArray.from_arrays([*(b.column(names.index(c)).take(order) for c in kept), pa.array(told, to_arrow_type(values)).take(order)], [*kept, "_values"])
            one = [b.column(names.index(c)).take(first) for c in ("_q", "_policy")]
            found = [pa.array(c, t) for c, t in zip(zip(*facts, strict=True) if facts else [[]] * 4, arrow, strict=True)]
            ends = pa.array(accumulate((len(g) for g in groups), initial=0), pa.int32())
            yield pa.RecordBatch.from_arrays([*one, *found, pa.ListArray.from_arrays(ends, rows)], out.names)

    return queries.mapInArrow(run, out)


def issue(when: Column, error_class: str, code: str, message: str | Column, token: Column | None = None, source: str = "static") -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(error_class).alias("error_class"), F.lit(code).alias("code"), message.alias("message"), (F.lit(None).cast("string") if token is None else token).alias("token"), F.lit(source).alias("source")))


@built_once
def engine_issue() -> Column:
    e = F.col("engine_error")
    token = F.trim(F.regexp_extract(e, r": (.+)$", 1))
    cls = code = message = None
    text = {
        "TAB_UNKNOWN": F.concat(F.lit("Table '"), token, F.lit("' does not exist in the schema.")),
        "COL_UNKNOWN": F.concat(F.lit("Column '"), token, F.lit("' does not exist in the referenced table(s).")),
        "AMB_COLUMN": F.concat(F.lit("Column reference '"), token, F.lit("' is ambiguous: it matches more than one table in FROM/JOIN.")),
        "SEM_FUNCTION": F.concat(F.lit("Function '"), token, F.lit("' does not exist.")),
        "SYN_ENGINE": F.when(e.contains("incomplete input"), "The query ends unexpectedly (missing operand, closing parenthesis or clause body).")
        .when(e.contains("one statement"), "Only a single SQL statement can be diagnosed at a time.")
        .when(e.contains("not authorized"), "This statement type is not allowed.")
        .when(e.rlike("near .*: syntax error"), F.concat(F.lit("Syntax error near "), F.regexp_extract(e, "near (.+): syntax error", 1), F.lit(".")))
        .otherwise(F.concat(F.lit("Syntax error: "), e, F.lit("."))),
    }
    for pattern, c, k in reversed(ENGINE):
        hit = e.rlike(f"(?i){pattern}")
        cls = F.when(hit, c).otherwise("SEMANTIC_ERROR" if cls is None else cls)
        code = F.when(hit, k).otherwise("SEM_ENGINE" if code is None else code)
        own = text.get(k, F.concat(F.upper(F.substring(e, 1, 1)), F.expr("substring(engine_error, 2)"), F.lit(".")))
        message = F.when(hit, own).otherwise(F.concat(e, F.lit(".")) if message is None else message)
    return F.when(e.isNotNull(), F.struct(cls.alias("error_class"), code.alias("code"), message.alias("message"), F.when(token != "", token).alias("token"), F.lit("engine").alias("source")))


def _each(scopes: Column, find) -> Column:
    """Issues that ``find`` (scope to an array of issues) gives for every SELECT."""
    return F.flatten(F.transform(scopes, find))


def _named(columns: Column, error_class: str, code: str, message, source: str = "static") -> Column:
    """One issue for each column-like struct; its text is the token."""
    return F.transform(columns, lambda c: F.struct(F.lit(error_class).alias("error_class"), F.lit(code).alias("code"), message(c).alias("message"), c["text"].alias("token"), F.lit(source).alias("source")))


@built_once
def policy_issues() -> Column:
    """Restricted tables, columns that resolve to restricted ones, and stars that would show these."""
    lower = lambda name: F.transform(F.coalesce(F.col(f"policy.{name}"), F.array().cast("array<string>")), F.lower)
    banned = F.array_intersect(F.array_distinct("tables"), lower("restricted_tables"))
    closed, text = lower("restricted_columns"), lambda x: F.struct(x.alias("text"))
    key = lambda t, c: F.concat(t, F.lit("."), c)
    shown = lambda s: F.flatten(F.transform(F.filter(s["items"], lambda i: i["star"]), lambda i: F.flatten(F.transform(
        F.filter(s["sources"], lambda x: x["t"].isNotNull() & ((i["owner"] == "") | (i["owner"] == x["alias"]))),
        lambda x: F.filter(F.transform(x["columns"], lambda c: key(x["t"], c)), lambda k: F.array_contains(closed, k))))))
    used = lambda s: F.array_distinct(F.filter(F.transform(s["columns"], lambda c: key(c["t"], c["c"])), lambda k: F.coalesce(F.array_contains(closed, k), F.lit(False))))
    denied = lambda what: lambda x: F.concat(F.lit(f"Access to {what} '"), x["text"], F.lit("' is denied by the access policy."))
    return F.concat(
        _named(F.transform(banned, text), "PERMISSION_DENIED", "POL_TABLE", denied("table"), "policy"),
        _each(F.col("scopes"), lambda s: F.concat(
            _named(F.transform(used(s), text), "PERMISSION_DENIED", "POL_COLUMN", denied("column"), "policy"),
            _named(F.transform(shown(s), text), "PERMISSION_DENIED", "POL_STAR", lambda x: F.concat(F.lit("'*' includes the restricted column '"), x["text"], F.lit("'.")), "policy"))),
    )


def _source_issues(s: Column) -> Column:
    alias = F.filter(F.transform(s["sources"], lambda x: x["alias"]), lambda a: a != "")
    twice = F.filter(F.array_distinct(alias), lambda a: F.size(F.filter(alias, lambda b: a == b)) > 1)
    text = lambda x: F.struct(x.alias("text"))
    return F.concat(
        _named(F.transform(twice, text), "AMBIGUOUS_REFERENCE", "AMB_ALIAS", lambda x: F.concat(F.lit("'"), x["text"], F.lit("' names more than one table in FROM/JOIN."))),
        _named(F.transform(s["loose"], text), "SEMANTIC_ERROR", "SEM_NO_JOIN", lambda x: F.concat(F.lit("Table '"), x["text"], F.lit("' is joined without a condition."))),
    )


def _comparison_issues(s: Column, typed: Column) -> Column:
    c, tests = s["compared"], ("=", "<>")
    itself = F.filter(c, lambda x: (x["kind"] == "column") & (F.lower(x["text"]) == F.lower(x["value"])))
    mixed = F.filter(c, lambda x: typed & (((x["type"] == "number") & (x["kind"] == "string") & ~x["value"].rlike(NUMERIC)) | ((x["type"] == "text") & (x["kind"] == "number"))))
    return F.concat(
        _named(F.filter(c, lambda x: (x["kind"] == "null") & x["op"].isin(*tests)), "SEMANTIC_ERROR", "SEM_NULL_CMP", lambda x: F.concat(F.lit("Comparing '"), x["text"], F.lit("' with NULL by "), x["op"], F.lit(" is never true; use IS NULL."))),
        _named(itself, "SEMANTIC_ERROR", "SEM_SELF_CMP", lambda x: F.concat(F.lit("'"), x["text"], F.lit("' is compared with itself."))),
        _named(mixed, "DATATYPE_MISMATCH", "TYP_LITERAL", lambda x: F.concat(F.lit("Column '"), x["text"], F.lit("' is compared with "), x["value"], F.lit(", a literal of another type."))),
        _named(F.filter(s["summed"], lambda x: typed & (x["type"] == "text")), "DATATYPE_MISMATCH", "TYP_AGGREGATE", lambda x: F.concat(F.lit("SUM/AVG of text column '"), x["text"], F.lit("'."))),
    )


def _group_issues(s: Column, typed: Column) -> Column:
    items, groups = s["items"], s["groups"]
    folds = F.exists(items, lambda i: i["folds"])
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    texts, names = F.transform(groups, lambda g: g["text"]), known(F.transform(groups, lambda g: g["name"]))
    keys = s["fixed"]
    aliases = F.filter(F.transform(items, lambda i: i["alias"]), lambda a: a != "")
    determined = lambda c: F.exists(s["sources"], lambda x: F.coalesce((x["t"] == c["t"]) & (F.size(x["keys"]) > 0) & F.forall(x["keys"], lambda k: F.array_contains(keys, F.concat(x["t"], F.lit("."), k))), F.lit(False)))
    resolved = lambda c: F.array_contains(keys, F.concat(c["t"], F.lit("."), c["c"])) | determined(c)
    covered = lambda c: F.array_contains(texts, F.lower(c["text"])) | F.array_contains(aliases, c["name"]) | F.when(c["t"].isNotNull(), resolved(c)).otherwise(F.array_contains(names, c["name"]) | ~typed)
    bare = F.filter(s["columns"], lambda c: c["bare"])
    shown = F.filter(bare, lambda c: (c["clause"] == "select") & ~F.coalesce(F.array_contains(texts, F.get(items, c["item"])["text"]), F.lit(False)))
    no = F.array().cast(f"array<{ISSUE}>")
    useless = s["having"] & ~s["having_folds"] & ~folds & ~s["grouped"]
    alone = _named(F.filter(bare, lambda c: c["clause"] == "select"), "SEMANTIC_ERROR", "SEM_UNGROUPED", lambda x: F.concat(F.lit("Column '"), x["text"], F.lit("' is selected beside an aggregate but is not in GROUP BY.")))
    uncovered = F.concat(F.filter(shown, lambda c: ~covered(c)), F.filter(bare, lambda c: (c["clause"] == "having") & ~covered(c)))
    within = _named(uncovered, "SEMANTIC_ERROR", "SEM_UNGROUPED", lambda x: F.concat(F.lit("Column '"), x["text"], F.lit("' is neither aggregated nor in GROUP BY.")))
    return (
        F.when(useless, F.array(issue(F.lit(True), "SEMANTIC_ERROR", "SEM_HAVING", "HAVING without GROUP BY or an aggregate; use WHERE.")))
        .when(~s["grouped"] & (folds | s["having"]), alone)
        .when(s["grouped"] & ~F.exists(groups, lambda g: g["literal"]), within).otherwise(no)
    )


@built_once
def static_issues() -> Column:
    typed = F.col("schema_checked")
    return _each(F.col("scopes"), lambda s: F.concat(_source_issues(s), _comparison_issues(s, typed), _group_issues(s, typed)))


@built_once
def all_issues() -> Column:
    """The issues of a row of ``compiled``, most urgent first."""
    empty, banned = F.col("_q") == "", F.col("_q").rlike(FORBIDDEN)
    guard = F.array(
        issue(empty, "SYNTAX_ERROR", "SYN_EMPTY", "The query is empty.", source="engine"),
        issue(banned, "SYNTAX_ERROR", "SYN_FORBIDDEN", "This statement type is not allowed.", source="engine"),
    )
    engine = F.array(engine_issue())
    grammatical = ~F.coalesce(F.element_at(engine, 1)["error_class"] == "SYNTAX_ERROR", F.lit(False))
    no = F.array().cast(f"array<{ISSUE}>")
    found = F.when(empty | banned, guard).otherwise(F.concat(engine, F.when(grammatical & F.col("schema_checked") & F.col("policy").isNotNull(), policy_issues()).otherwise(no), F.when(F.col("engine_error").isNull(), static_issues()).otherwise(no)))
    place = F.create_map(*(F.lit(x) for p in PRIORITY.items() for x in p))
    ranked = F.array_sort(F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x, i: F.struct(place[x["error_class"]].alias("p"), i.alias("i"), x.alias("x"))))
    return F.array_distinct(F.transform(ranked, lambda r: r["x"]))


@built_once
def told_issues() -> Column:
    """The issues of a text: those of the texts that are like it, with its own values for the marks."""
    values = F.col("_r._values")
    piece = lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(values, F.substring(p, 1, 3).cast("int")), F.substring(p, F.lit(4), F.length(p))))
    put = lambda t: F.when(t.contains(MARK), F.array_join(F.transform(F.split(t, f"_?{MARK}", -1), piece), "")).otherwise(t)
    own = F.transform("issues", lambda x: x.withField("message", put(x["message"])).withField("token", put(x["token"])))
    return F.when(values.isNotNull() & F.exists("issues", lambda x: x["message"].contains(MARK)), F.array_distinct(own)).otherwise(F.col("issues"))


def diagnose(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """queries with error_class, issues (most urgent first), engine_error, schema_checked.

    A db_id that the catalog lacks is checked for grammar and rules without types: messages about
    unknown names do not count there.  A null or empty text is a syntax error.
    """
    q = queries if "policy" in queries.columns else queries.withColumn("policy", F.lit(None).cast("struct<restricted_tables array<string>, restricted_columns array<string>>"))
    names, policy = q.columns, q.schema["policy"].dataType
    kept = [c for c in names if c != "policy"]
    # policies travel as text: Spark's Arrow writer goes over a whole batch at every null struct of arrays
    q = compiled(q.select(*kept, F.to_json("policy").alias("_policy"), normalize_query(F.col("sql")).alias("_q")), catalog, kept)
    q = q.withColumn("policy", F.from_json("_policy", policy))
    q = q.withColumn("engine_error", F.when(F.col("schema_checked") | ~F.col("engine_error").rlike(f"(?i){UNKNOWN_NAME.pattern}"), F.col("engine_error")))
    q = q.withColumn("issues", all_issues())
    q = q.withColumn("error_class", F.when(F.size("issues") > 0, F.col("issues")[0]["error_class"]).otherwise("CORRECT"))
    q = q.select(F.explode("_rows").alias("_r"), "policy", "error_class", "issues", "engine_error", "schema_checked")
    return q.select(*("policy" if c == "policy" else F.col("_r")[c].alias(c) for c in names), "error_class", told_issues().alias("issues"), "engine_error", "schema_checked")
