"""Token rows of query texts, and what one looks up in them: neighbours, clause ends, lists, literals; edits by spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Strings, quoted names, words and numbers, operators of two characters, other signs.
PATTERN = r"'[^']*(?:''[^']*)*'|\"[^\"]*\"|\w+|<>|<=|>=|!=|==|[^\s\w]"
#: Words that begin a clause.
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT")


def token_rows(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """The columns of queries without the text, and idx (from 0), token, depth (parentheses around it): one row for each token."""
    rest = [c for c in queries.columns if c != sql]
    listed = F.regexp_extract_all(F.col(sql), F.lit(f"({PATTERN})"), F.lit(1))
    step = lambda x: F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
    rows = queries.select(*rest, F.posexplode(listed).alias("idx", "token"))
    opened = F.sum(step(F.col("token"))).over(W.partitionBy(*rest).orderBy("idx"))
    return rows.withColumn("depth", (opened - F.when(F.col("token") == "(", 1).otherwise(0)).cast("int"))


def with_neighbours(tokens: DataFrame, *query: str) -> DataFrame:
    """Adds prev, next and is_function_name (a word right before an opening parenthesis, no clause or condition word)."""
    w = W.partitionBy(*query).orderBy("idx")
    out = tokens.withColumns({"prev": F.lag("token").over(w), "next": F.lead("token").over(w)})
    words = (*CLAUSES, "AND", "OR", "NOT", "IN", "ON", "BY", "AS", "VALUES", "EXISTS", "USING", "OVER")
    return out.withColumn("is_function_name", F.coalesce((F.col("next") == "(") & F.col("token").rlike(r"^[A-Za-z_]\w*$") & ~F.upper("token").isin(*words), F.lit(False)))


def with_clause_ends(tokens: DataFrame, *query: str) -> DataFrame:
    """Adds clause_end: idx of the last token before the next clause word of the same depth, or before the parentheses around close."""
    # the closing parenthesis around a token is the next one of a depth less by one: among the tokens of a depth and the
    # parentheses that close it, the next of these; so each token is given out once, and a closing one twice
    closing = F.col("token") == ")"
    own = F.struct(F.col("depth").alias("level"), F.lit(None).cast("int").alias("close"))
    levels = F.when(closing, F.array(own, F.struct((F.col("depth") + 1).alias("level"), F.col("idx").alias("close")))).otherwise(F.array(own))
    dealt = tokens.withColumn("_last", F.max("idx").over(W.partitionBy(*query))).withColumn("_l", F.explode(levels))
    later = W.partitionBy(*query, "_l.level").orderBy("idx").rowsBetween(1, W.unboundedFollowing)
    starts = F.when(F.upper("token").isin(*CLAUSES) & F.col("_l.close").isNull(), F.col("idx"))
    ends = dealt.withColumns({"_start": F.min(starts).over(later), "_c": F.min("_l.close").over(later)}).filter("_l.close is null")
    return ends.select(*tokens.columns, (F.coalesce(F.least("_start", "_c"), F.col("_last") + 1) - 1).alias("clause_end"))


def in_from_lists(tokens: DataFrame, *query: str) -> DataFrame:
    """Adds in_from: whether the last clause word of the same depth up to the token is FROM."""
    last = F.last(F.when(F.upper("token").isin(*CLAUSES), F.upper("token")), ignorenulls=True)
    return tokens.withColumn("in_from", F.coalesce(last.over(W.partitionBy(*query, "depth").orderBy("idx")) == "FROM", F.lit(False)))


def string_literals(sql: Column, names: Column) -> Column:
    """The strings of a query: '...', and "..." that is none of ``names`` (array, lower case)."""
    single = F.transform(F.regexp_extract_all(sql, F.lit(r"'((?:[^']|'')*)'"), F.lit(1)), lambda x: F.replace(x, F.lit("''"), F.lit("'")))
    double = F.filter(F.regexp_extract_all(F.regexp_replace(sql, r"'(?:[^']|'')*'", "''"), F.lit(r'"([^"]*)"'), F.lit(1)), lambda x: ~F.array_contains(names, F.lower(x)))
    return F.concat(single, double)


def edited(text: Column, edits: Column) -> Column:
    """A text with edits array<struct<start, end, new>> (code points, end exclusive) applied; an error where two overlap."""
    ordered = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["new"].alias("new"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(True).alias("fine"))
    piece = lambda a, n: F.substring(text, a + 1, F.greatest(n, F.lit(0)))
    step = lambda s, e: F.struct(F.concat(s["out"], piece(s["at"], e["start"] - s["at"]), e["new"]).alias("out"), e["end"].alias("at"), (s["fine"] & (e["start"] >= s["at"])).alias("fine"))
    return F.aggregate(ordered, start, step, lambda s: F.when(s["fine"], F.concat(s["out"], piece(s["at"], F.length(text)))).otherwise(F.raise_error(F.lit("edits overlap")).cast("string")))


def span_edit(start: Column, end: Column, new: Column) -> Column:
    """One edit for ``edited``: a replacement; an insertion where both ends are equal."""
    return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("new")))
