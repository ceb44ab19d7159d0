"""Functions for SQL users: names that SQLite has and Spark lacks, fuzzy matching, token rows."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from ..operators.fuzzy import match_ratio, osa_distance

#: Temporary SQL functions for SQLite's names.
SQL_FUNCTIONS = {
    "julianday": "(t TIMESTAMP) RETURNS DOUBLE RETURN unix_micros(t) / 86400000000.0 + 2440587.5",
    "strftime": "(f STRING, t TIMESTAMP) RETURNS STRING RETURN date_format(t, replace(replace(replace(replace(replace(replace(f, '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'))",
    "datetime": "(t TIMESTAMP) RETURNS STRING RETURN date_format(t, 'yyyy-MM-dd HH:mm:ss')",
    "sql_normalize": r"(q STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(coalesce(q, ''), '^\\s+', ''), '[\\s;]+$', '')",
    "total": "(xs ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(xs, 0.0D, (s, x) -> s + coalesce(x, 0.0D))",
    "group_concat": "(xs ARRAY<STRING>) RETURNS STRING RETURN array_join(xs, ',')",
    "quote_ident": "(x STRING) RETURNS STRING RETURN concat('\"', replace(x, '\"', '\"\"'), '\"')",
}
TOKEN = re.compile(r"\s+|'[^']*(?:''[^']*)*'|\"[^\"]*\"|\w+|<>|<=|>=|!=|\|\||.", re.S)


def register_corpus(spark: SparkSession, queries: str, catalog: DataFrame, prefix: str = "sql_") -> None:
    """Views over a table or view of queries (id, db_id, sql, and policy if it has one): <prefix>diagnose, <prefix>issues (a row each) and <prefix>repair."""
    from ..operators.diagnose import diagnose
    from ..operators.repair import repair

    found = diagnose(spark.table(queries), catalog)
    found.createOrReplaceTempView(f"{prefix}diagnose")
    found.select("id", F.posexplode("issues").alias("place", "issue")).select("id", "place", "issue.*").createOrReplaceTempView(f"{prefix}issues")
    repair(spark.table(queries), catalog).createOrReplaceTempView(f"{prefix}repair")


def _columns(rows: AnalyzeArgument, *names: AnalyzeArgument) -> list[StructField]:
    """The columns of a TABLE argument that constant arguments name, in any case of letters; an error where one is missing."""
    if not rows.isTable:
        raise ValueError("the first argument is a TABLE")
    known = {f.name.lower(): f for f in rows.dataType.fields}
    missing = [n.value for n in names if not n.isConstantExpression or str(n.value).lower() not in known]
    if missing:
        raise ValueError(f"no such column: {missing}")
    return [known[str(n.value).lower()] for n in names]


class QueryTokens:
    """``query_tokens(TABLE(q), 'id', 'sql')``: the key's column, idx, token, depth; only the two columns are read.  Null and empty texts give no row."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        k, t = _columns(rows, key, text)
        if k.name == t.name:
            raise ValueError("the key and the text are one column")
        tokens = [StructField("idx", IntegerType()), StructField("token", StringType()), StructField("depth", IntegerType())]
        return AnalyzeResult(StructType([StructField(k.name, k.dataType), *tokens]), select=[SelectedColumn(f"`{k.name}`"), SelectedColumn(f"`{t.name}`")])

    def eval(self, row, key: str, text: str):
        depth = idx = 0
        for m in TOKEN.finditer(row[1] or ""):
            if m[0].isspace():
                continue
            depth -= m[0] == ")"
            yield row[0], idx, m[0], depth
            depth += m[0] == "("
            idx += 1


class Runs:
    """``runs(TABLE(t) PARTITION BY client ORDER BY (at), 'client', 'class', 'at')``: the key's column, run (from 1), the
    value's column, n, started, ended, for rows in a run that have the same value; null is a value of its own.

    One run is held at a time, so a partition may be of any length; each must hold one key.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument, at: AnalyzeArgument) -> AnalyzeResult:
        k, v, t = _columns(rows, key, value, at)
        return AnalyzeResult(StructType([StructField(k.name, k.dataType), StructField("run", LongType()), StructField(v.name, v.dataType), StructField("n", LongType()), StructField("started", t.dataType), StructField("ended", t.dataType)]))

    def __init__(self):
        self.held, self.number = None, 0

    def eval(self, row, key: str, value: str, at: str):
        cell = {k.lower(): x for k, x in row.asDict().items()}
        k, v, t = (cell[c.lower()] for c in (key, value, at))
        if self.held and self.held[2] == v:
            self.held[3], self.held[5] = self.held[3] + 1, t
            return
        if self.held:
            yield tuple(self.held)
        self.number += 1
        self.held = [k, self.number, v, 1, t, t]

    def terminate(self):
        if self.held:
            yield tuple(self.held)


def register(spark: SparkSession) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("osa_distance", osa_distance)
    spark.udf.register("match_ratio", match_ratio)

    @F.udtf(returnType="idx int, token string, start int, end int, depth int")
    class SqlTokens:
        """One row for each token; depth counts the parentheses around it."""

        def eval(self, sql: str):
            depth = idx = 0
            for m in TOKEN.finditer(sql or ""):
                if m[0].isspace():
                    continue
                depth -= m[0] == ")"
                yield idx, m[0], m.start(), m.end(), depth
                depth += m[0] == "("
                idx += 1

    @F.udtf(returnType="idx int, query string")
    class SplitQueries:
        """Statements of pasted text, split at semicolons outside of quotes."""

        def eval(self, text: str):
            parts = re.split(r";(?=(?:[^']*'[^']*')*[^']*$)", text or "")
            for i, p in enumerate(p.strip() for p in parts if p.strip()):
                yield i, p

    @F.udtf(returnType="idx int, kind string, part string")
    class WordDiff:
        """same, removed and added runs of words."""

        def eval(self, before: str, after: str):
            a, b = re.findall(r"\s+|\S+", before or ""), re.findall(r"\s+|\S+", after or "")
            i = 0
            for tag, a1, a2, b1, b2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                for kind, part in (("same", a[a1:a2]),) if tag == "equal" else (("removed", a[a1:a2]), ("added", b[b1:b2])):
                    if part:
                        yield i, kind, "".join(part)
                        i += 1

    for name, f in (("sql_tokens", SqlTokens), ("split_queries", SplitQueries), ("word_diff", WordDiff), ("query_tokens", F.udtf(QueryTokens)), ("runs", F.udtf(Runs))):
        spark.udtf.register(name, f)
