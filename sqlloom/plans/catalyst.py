"""The Spark dialect: checking queries with Catalyst, and running read-only queries.

Checking analyses a query on empty views and never runs it.  It works on the
driver, one query at a time, for interactive use; corpora go through
``operators.diagnose``.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.register import SQL_FUNCTIONS

#: Spark's error conditions by class, by their beginning; any other condition is SEMANTIC_ERROR.
CONDITIONS = (
    ("PARSE_", "SYNTAX_ERROR"), ("TRAILING_COMMA", "SYNTAX_ERROR"), ("TABLE_OR_VIEW_NOT_FOUND", "UNKNOWN_TABLE"),
    ("UNRESOLVED_COLUMN", "UNKNOWN_COLUMN"), ("UNRESOLVED_USING", "UNKNOWN_COLUMN"), ("AMBIGUOUS_", "AMBIGUOUS_REFERENCE"),
    ("DATATYPE_MISMATCH.IN_SUBQUERY", "SEMANTIC_ERROR"), ("DATATYPE_MISMATCH", "DATATYPE_MISMATCH"),
)
TYPES = {"number": "decimal(38,10)", "text": "string", "time": "timestamp", "boolean": "boolean", "other": "string"}


def create_views(spark: SparkSession, catalog: DataFrame, db_id: str) -> None:
    """An empty typed view for each table of a database."""
    for r in catalog.filter(F.col("db_id") == db_id).collect():
        schema = ", ".join(f"`{c['name']}` {TYPES[c['type']]}" for c in r["columns"])
        spark.createDataFrame([], schema).createOrReplaceTempView(r["table_name"])


def check(spark: SparkSession, sql: str) -> tuple[str, str | None]:
    """(class, condition) of a query under Spark's rules; reserved words cannot be aliases."""
    key = "spark.sql.ansi.enforceReservedKeywords"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        spark.sql(sql).schema  # noqa: B018
        return "CORRECT", None
    except ParseException as e:
        return "SYNTAX_ERROR", e.getCondition()
    except AnalysisException as e:
        condition = e.getCondition() or ""
        return next((c for k, c in CONDITIONS if condition.startswith(k)), "SEMANTIC_ERROR"), condition
    finally:
        spark.conf.set(key, before)


#: Kinds of nodes of a parsed query.  Anything else, all commands among them, is refused.
KINDS = {
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedTableValuedFunction",
    "UnresolvedTVFAliases", "OneRowRelation", "OneRowRelation$", "LocalRelation", "Window", "WithWindowDefinition", "LateralJoin", "Generate", "Pivot", "Unpivot", "UnresolvedHint", "Sample",
    "Expand", "Tail", "PipeOperator", "UnresolvedOrderBy", "ResolvedInlineTable",
}
#: Expressions that hold a plan.
HELD = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")
#: Table functions that make rows from their arguments only.
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple")
#: Functions that reach outside of the query: into the JVM, to files, to a model, or to the session.
CLOSED = ("java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "from_avro", "to_avro", "from_protobuf", "to_protobuf", "raise_error", "assert_true", "sleep")

#: Functions that ``functions.register`` adds.
OWN = {*SQL_FUNCTIONS, "osa_distance", "match_ratio"}


def allowed_functions(spark: SparkSession) -> set[str]:
    """Names that a query may call: Spark's own but those that reach outside, and this library's.  What else a session registers is not among them."""
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().listFunction()
    return {registry.apply(i).funcName().lower() for i in range(registry.size())} - set(CLOSED) | OWN


def _every_node(spark: SparkSession, plan):
    """All nodes of a parsed plan: children, plans named in WITH, and those inside expressions; and all expressions."""
    todo = [(plan, True)]
    while todo:
        node, is_plan = todo.pop()
        yield node, is_plan
        children = node.children()
        todo += [(children.apply(i), is_plan) for i in range(children.size())]
        if is_plan:
            expressions = node.expressions()
            todo += [(expressions.apply(i), False) for i in range(expressions.size())]
            if node.getClass().getSimpleName() == "UnresolvedWith":
                named = node.cteRelations()
                todo += [(named.apply(i)._2(), True) for i in range(named.size())]
        elif node.getClass().getSimpleName() in HELD:
            todo.append((node.plan(), True))


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether the text is one statement that only reads tables of the session.

    Decided on the parsed plan, sub-queries and WITH included: only known kinds of nodes (no command),
    only functions of ``allowed_functions``, only the table functions of TABLE_FUNCTIONS, and every relation is a temporary view or a table of
    the catalog: a name like ``csv.`/path` `` is neither.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    functions, catalog, named = allowed_functions(spark), spark._jsparkSession.sessionState().catalog(), set()
    parts = lambda x: [x.apply(i) for i in range(x.size())]
    nodes = list(_every_node(spark, plan))
    for node, is_plan in nodes:
        if is_plan and node.getClass().getSimpleName() == "UnresolvedWith":
            relations = node.cteRelations()
            named |= {relations.apply(i)._1().lower() for i in range(relations.size())}
    for node, is_plan in nodes:
        kind = node.getClass().getSimpleName()
        if is_plan and kind not in KINDS:
            return False
        if kind == "UnresolvedRelation":
            name = parts(node.multipartIdentifier())
            if len(name) == 1 and (name[0].lower() in named or catalog.getTempView(name[0]).isDefined()):
                continue
            if not spark.catalog.tableExists(".".join(f"`{x.replace('`', '``')}`" for x in name)):
                return False
        elif kind == "UnresolvedTableValuedFunction":
            name = parts(node.name())
            if len(name) != 1 or name[0].lower() not in TABLE_FUNCTIONS:
                return False
        elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = parts(node.nameParts()) if kind == "UnresolvedFunction" else [node.name().funcName()]
            if len(name) != 1 or name[0].lower() not in functions:
                return False
        elif not is_plan and ("CallMethodViaReflection" in kind or ("Subquery" in kind and kind not in (*HELD, "InSubquery"))):
            return False
    return True


def execute(spark: SparkSession, sql: str, limit: int = 1000, seconds: float | None = None) -> dict:
    """columns, rows (at most ``limit``), row_count, truncated, elapsed_ms of a read-only query, which is cancelled after ``seconds``."""
    if not is_query(spark, sql):
        raise ValueError("only a single read-only query of tables can be executed")
    began, group = time.time(), f"execute-{uuid.uuid4().hex}"
    df = spark.sql(sql)
    clean = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema] if len(set(df.columns)) == len(df.columns) else ["*"]
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop) if seconds is not None else None
    spark.sparkContext.setJobGroup(group, "read-only query", interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        rows = df.select(*clean).limit(limit + 1).collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query took more than {seconds} s") from e
        raise
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return {"columns": df.columns, "rows": [list(r) for r in rows[:limit]], "row_count": min(len(rows), limit), "truncated": len(rows) > limit, "elapsed_ms": (time.time() - began) * 1000}
