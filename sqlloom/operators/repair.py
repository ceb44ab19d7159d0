"""Repairing queries: candidates by joins and column expressions, accepted only after diagnosis.

A round takes the primary issue of each wrong query, explodes its candidates,
diagnoses them all, and keeps the best one that removes the issue: fewest
urgent problems first, then preference, number of issues and size of the edit.
Rounds go on until every query is correct or stuck.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.built import built_once
from ..functions.edits import each, once, tidy
from ..functions.text import normalize_query
from ..labels import PRIORITY
from ..plans.stages import discard, folder, interpreted, spread, written
from .diagnose import diagnose
from .fuzzy import KEYWORDS, closest, edit_size, keyword_matches, words_to_number

#: Functions that are known, other names for them, and what an insertion search tries.
FUNCTIONS = (
    "count", "sum", "avg", "min", "max", "lower", "upper", "length", "abs", "round", "substr", "coalesce", "ifnull", "strftime", "date",
    "julianday", "replace", "trim", "instr", "group_concat", "total", "cast", "nullif", "datetime", "time",
)
SYNONYMS = {
    "average": "avg", "mean": "avg", "avrg": "avg", "maximum": "max", "minimum": "min", "cnt": "count", "number": "count", "count_all": "count",
    "counts": "count", "summ": "sum", "sums": "sum", "summation": "sum", "len": "length", "lcase": "lower", "ucase": "upper",
    "substring": "substr", "isnull": "ifnull", "nvl": "ifnull",
}
INSERTABLE = (",", "FROM", "WHERE", "BY", ")", "(", "ON", "AND", "SELECT", "=")
DELETIONS, INSERTIONS = 200, 150
GLUES = (" ", "(", ") ", ", ")
LINKS = "array<struct<table_name string, column string, target_table string, target_column string, preference int>>"
CANDIDATE = "array<struct<sql string, description string, preference int>>"
#: What a deletion may take: words that are keywords, and signs; names, strings, numbers and comparisons stay.
DELETABLE = rf"(?i)^(?:{'|'.join(KEYWORDS)}|[^\w\s'\"`=<>!*])$"
AGG = r"(?:count|sum|avg|min|max|total)"
END = r"(?= HAVING| ORDER BY| LIMIT|$)"


def fk_conditions(keys: DataFrame) -> DataFrame:
    """a, b, condition for every foreign key in both directions.  keys: table_name, column, target_table, target_column."""
    side = lambda t, c: F.concat(F.col(t), F.lit("."), F.col(c))
    both = F.array(
        F.struct(F.col("table_name").alias("a"), F.col("target_table").alias("b"), F.concat(side("table_name", "column"), F.lit(" = "), side("target_table", "target_column")).alias("condition")),
        F.struct(F.col("target_table").alias("a"), F.col("table_name").alias("b"), F.concat(side("target_table", "target_column"), F.lit(" = "), side("table_name", "column")).alias("condition")),
    )
    return keys.select(F.explode(both).alias("k")).select("k.*")


def _as(options: Column, description: str, preference: int = 0) -> Column:
    return F.transform(options, lambda x: F.struct(x.alias("sql"), F.lit(description).alias("description"), F.lit(preference).alias("preference")))


def _when(code: str | tuple[str, ...], *options: Column) -> tuple[set[str], Column]:
    codes = (code,) if isinstance(code, str) else code
    return set(codes), F.when(F.col("code").isin(*codes), F.concat(*options)).otherwise(F.array().cast(CANDIDATE))


def rewrites(codes: set[str]) -> Column:
    """Candidates from the text, its issue and the links between tables of its database; only the parts that some code calls for."""
    return F.concat(F.array().cast(CANDIDATE), *(options for of, options in _rewrites() if of & codes))


@built_once
def _rewrites() -> list[tuple[set[str], Column]]:
    """Which codes, and their candidates."""
    s = F.col("sql")
    fold = lambda p, r: once(s, p, r)
    from_table = r"(?is)^(.*?\bFROM (\w+)\b.*?) WHERE (.*?)([\w.]+) ?(=|<>|!=|<=|>=|<|>) ?"
    plain = F.filter(F.transform(F.split(F.regexp_extract(s, r"(?i)\bSELECT (?:DISTINCT )?(.*?) FROM ", 1), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z_][\w.]*$"))
    group = F.when(s.rlike(r"(?i)\bGROUP BY\b"), F.regexp_replace(s, F.lit(r"(?is)(\bGROUP BY .*?)" + END), F.concat(F.lit("$1, "), F.col("token")))).otherwise(F.regexp_replace(s, F.lit(r"(?is)^(.*?)(?= HAVING| ORDER BY| LIMIT|$)"), F.concat(F.lit("$1 GROUP BY "), F.array_join(plain, ", "))))
    # the pattern for "up to the end" also matches the empty rest, so only the first match counts
    group = F.regexp_replace(group, r"( GROUP BY [^()]*?)( GROUP BY .*)$", "$1")
    quoted = each(s, r"(?<=[=<>(] ?)\b\d+(?:\.\d+)?\b(?! ?[),] ?\()", lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    number = each(s, r"(?<=[=<>] )'[^']*'", lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")), words_to_number(F.translate(x, "'", "")).cast("string"), x))
    tokens = r"\w+|'[^']*'|\"[^\"]*\"|`[^`]*`|[^\s\w]"
    without = lambda x: F.when(x.rlike(DELETABLE), "").otherwise(x)
    joined_words = "|".join(k for k in KEYWORDS if len(k) > 2)
    words = F.split(F.upper(s), r"\W+")
    # one name more than the text has words, so one of them is free
    free = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.size(words) + 1), lambda i: F.concat(F.lit("T"), i.cast("string"))), lambda x: ~F.array_contains(words, x)), F.lit(0))
    twice = r"(?is)(\b(?:FROM|JOIN|,) \w+ (?:AS )?)(\w+)(\b.*?(?:\bJOIN|,) \w+ (?:AS )?)\2\b(.*?= ?)\2\."
    same = r"(?is)(\bFROM (\w+)\b.*?\bJOIN \2)\b(?! AS)(.*?= ?)\2\."
    renamed = F.filter(F.array(F.regexp_replace(s, F.lit(twice), F.concat(F.lit("$1$2$3"), free, F.lit("$4"), free, F.lit("."))), F.regexp_replace(s, F.lit(same), F.concat(F.lit("$1 AS "), free, F.lit("$3"), free, F.lit(".")))), lambda x: x != s)
    shown = F.transform(F.split(F.regexp_extract(s, r"(?i)\bSELECT (?:DISTINCT )?(.*?) FROM ", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"(?i) AS \w+$", ""))
    return [
        _when("SYN_ENGINE",
              _as(fold(r"(?i)\b(GROUP|ORDER) (?!BY\b)", "$1 BY "), "insert BY"),
              _as(fold(r"(?i)\b\w+?(SELECT|FROM|WHERE|GROUP|ORDER|HAVING|JOIN|LIMIT)\b", "$1"), "split joined words", -1),
              *(_as(F.concat(fold(rf"(?i)\b(\w+?)({joined_words})\b", f"$1{g}$2"), fold(rf"(?i)\b({joined_words})(\w+)\b", f"$1{g}$2")), "split joined words") for g in GLUES),
              _as(F.transform(each(s, tokens, without, DELETIONS), tidy), "delete a token", 1),
              _as(F.flatten(F.array(*(F.transform(each(s, r"\s+|(?=[(),=])|$", lambda x, k=k: F.concat(F.lit(f" {k} ")), INSERTIONS), tidy) for k in INSERTABLE))), "insert a token", 1),
              _as(F.when(~s.rlike(r"(?i)^\(*\s*(SELECT|WITH|VALUES)\b"), F.array(F.concat(F.lit("SELECT "), s))).otherwise(F.array().cast("array<string>")), "prepend SELECT"),
              _as(F.when(F.length(F.regexp_replace(s, "[^']", "")) % 2 == 1, F.concat(F.array(F.concat(s, F.lit("'"))), each(s, r"(?<=\w)(?= |$)", "'"))).otherwise(F.array().cast("array<string>")), "close the string"),
              _as(F.array(_in_order(s)), "reorder clauses", -2)),
        _when("TYP_LITERAL", _as(quoted, "quote the number"), _as(number, "number instead of text")),
        _when("TYP_AGGREGATE", _as(fold(r"(?i)\b(SUM|AVG)\s*\(\s*((?:DISTINCT )?)([\w.]+)\s*\)", "$1($2CAST($3 AS REAL))"), "cast the argument")),
        _when("SEM_NULL_CMP", _as(fold(r"(?i)([\w.]+)\s*=\s*NULL\b", "$1 IS NULL"), "IS NULL"), _as(fold(r"(?i)([\w.]+)\s*(?:<>|!=)\s*NULL\b", "NOT $1 IS NULL"), "IS NOT NULL")),
        _when("SEM_SELF_CMP", _as(fold(r"(?i) WHERE ([\w.]+) ?(?:=|<>|<=|>=|<|>) ?\1(?: AND)?(?= |$)", " WHERE"), "drop the comparison", 1), _as(fold(r"(?i) WHERE ([\w.]+) ?(?:=|<>|<=|>=|<|>) ?\1$", ""), "drop the comparison")),
        _when("SEM_AGGREGATE",
              _as(fold(from_table + rf"({AGG})\(([^()]*)\)(.*)$", "$1 WHERE $3$4 $5 (SELECT upper:$6($7) FROM $2)$8"), "scalar subquery"),
              _as(fold(rf"(?is) WHERE ([^()]*?{AGG}\([^()]*\)[^()]*?)( GROUP BY .*?)?" + END, "$2 HAVING $1"), "HAVING instead of WHERE", 1)),
        _when("SEM_HAVING", _as(fold(r"(?i)\bHAVING\b", "WHERE"), "WHERE instead of HAVING")),
        _when("SEM_UNGROUPED", _as(F.array(group), "complete GROUP BY"), _as(F.array(F.regexp_replace(s, F.concat(F.lit(r"(?i)(?<=SELECT |, )"), F.col("token"), F.lit(r"(?=,| FROM)")), F.concat(F.lit("MAX("), F.col("token"), F.lit(")")))), "aggregate the column", 1)),
        _when("SEM_POSITION", _as(F.transform(shown, lambda x: F.regexp_replace(s, F.lit(r"(?i)\b(ORDER|GROUP) BY \d+"), F.concat(F.lit("$1 BY "), x))), "an item instead of a position")),
        _when("SEM_SUBQUERY_ARITY", _as(fold(r"(?i)(\(SELECT (?:DISTINCT )?[\w.]+)(?:, [\w.*]+)+ FROM", "$1 FROM"), "one column"), _as(fold(r"(?i)\(SELECT (?:[\w.]+, )+([\w.]+) FROM", "(SELECT $1 FROM"), "one column", 1)),
        _when("SEM_SET_ARITY", _as(_same_items(s), "the items that both sides have", -1), _as(each(s, r"(?i), [\w.]+(?= FROM)|(?<=SELECT )[\w.]+, ", ""), "drop a column")),
        _when("SEM_ARGUMENTS", _as(fold(r"\b(\w+)\(([^(),]+),[^()]*\)", "$1($2)"), "first argument only")),
        _when("SEM_NO_JOIN", _join_conditions()),
        _when(("AMB_ALIAS", "AMB_COLUMN"), _as(renamed, "new alias", -1)),
        _when("COL_UNKNOWN", _as(_key_partners(), "foreign-key partner", -1)),
    ]


def _in_order(s: Column) -> Column:
    """A text without parentheses or set operators whose clauses stand in their order, each kept as it is; else the text."""
    names = ("SELECT", "FROM", "WHERE", r"GROUP\s+BY", "HAVING", r"ORDER\s+BY", "LIMIT")
    every = "|".join(names)
    clauses = F.regexp_extract_all(s, F.lit(rf"(?is)(\b(?:{every})\b.*?)(?=\s*\b(?:{every})\b|\s*$)"), F.lit(1))
    place = lambda x: F.coalesce(*(F.when(x.rlike(rf"(?i)^{n}\b"), i) for i, n in enumerate(names)))
    ordered = F.transform(F.array_sort(F.transform(clauses, lambda x, i: F.struct(place(x).alias("p"), i.alias("i"), x.alias("x")))), lambda y: F.trim(y["x"]))
    plain = s.rlike(r"(?i)^\s*SELECT\b") & ~s.rlike(r"(?i)\b(UNION|INTERSECT|EXCEPT)\b|\(\s*SELECT\b")
    return F.when(plain, F.array_join(ordered, " ")).otherwise(s)


def _same_items(s: Column) -> Column:
    """For two SELECTs of different width: both with the items only whose names the other has too, in the first one's order."""
    parts = r"(?is)^SELECT (DISTINCT )?(.*?) (FROM .*?) (UNION ALL|UNION|INTERSECT|EXCEPT) SELECT (DISTINCT )?(.*?) (FROM .*)$"
    items = lambda i: F.transform(F.split(F.regexp_extract(s, parts, i), ","), lambda x: F.trim(x))
    name = lambda x: F.lower(F.regexp_replace(x, r"^.*(?:\.|\s)", ""))
    a, b = items(2), items(6)
    left = F.filter(a, lambda x: F.exists(b, lambda y: name(x) == name(y)))
    right = F.transform(left, lambda x: F.get(F.filter(b, lambda y: name(x) == name(y)), F.lit(0)))
    text = F.concat(F.lit("SELECT "), F.regexp_extract(s, parts, 1), F.array_join(left, ", "), F.lit(" "), F.regexp_extract(s, parts, 3), F.lit(" "), F.regexp_extract(s, parts, 4), F.lit(" SELECT "), F.regexp_extract(s, parts, 5), F.array_join(right, ", "), F.lit(" "), F.regexp_extract(s, parts, 7))
    return F.when(s.rlike(parts) & (F.size(left) > 0), F.array(text)).otherwise(F.array().cast("array<string>"))


def _sources() -> Column:
    """array<struct<t, a>>: tables and aliases behind FROM, JOIN and commas, in lower case."""
    pattern = r"(?i)(?:\bFROM|\bJOIN|,) (\w+)(?: (?:AS )?(?!(?:ON|WHERE|JOIN|GROUP|ORDER|USING|LEFT|INNER|CROSS|NATURAL|LIMIT|HAVING|UNION|INTERSECT|EXCEPT)\b)(\w+))?"
    lists = F.regexp_extract_all("sql", F.lit(r"(?is)\b(FROM .*?)(?= WHERE\b| GROUP\b| ORDER\b| LIMIT\b| HAVING\b| UNION\b| INTERSECT\b| EXCEPT\b|\)|$)"), F.lit(1))
    found = F.arrays_zip(*(F.regexp_extract_all(F.array_join(lists, " ; "), F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "t"), (2, "a"))))
    return F.transform(found, lambda x: F.struct(F.lower(x["t"]).alias("t"), F.lower(F.when(x["a"] != "", x["a"]).otherwise(x["t"])).alias("a")))


def _join_conditions() -> Column:
    """ON <condition>, or AND <condition>, behind the table that the issue names, for its links with the other tables of the query."""
    s, token = F.col("sql"), F.lower("token")
    own = F.get(F.filter("sources", lambda x: x["a"] == token), F.lit(0))["t"]
    both = lambda a, x, b, y: F.concat(a, F.lit("."), x, F.lit(" = "), b, F.lit("."), y)
    ways = F.flatten(F.transform(F.filter("sources", lambda x: x["a"] != token), lambda o: F.flatten(F.transform("links", lambda k: F.filter(F.array(
        F.when((k["table_name"] == own) & (k["target_table"] == o["t"]), F.struct(both(F.col("token"), k["column"], o["a"], k["target_column"]).alias("c"), k["preference"].alias("p"))),
        F.when((k["table_name"] == o["t"]) & (k["target_table"] == own), F.struct(both(o["a"], k["column"], F.col("token"), k["target_column"]).alias("c"), k["preference"].alias("p")))), lambda x: x.isNotNull())))))
    place = F.concat(F.lit(r"(?is)(\bJOIN (?:\w+(?: AS)? )?"), F.col("token"), F.lit(r"\b)( ON .*?)?(?= WHERE\b| GROUP\b| ORDER\b| LIMIT\b| JOIN\b| LEFT\b| INNER\b|$)"))
    has_on = F.rlike(s, F.concat(F.lit(r"(?is)\bJOIN (?:\w+(?: AS)? )?"), F.col("token"), F.lit(r" ON ")))
    return F.transform(ways, lambda w: F.struct(F.regexp_replace(s, place, F.concat(F.when(has_on, "$1$2 AND ").otherwise("$1 ON "), _cased(w["c"]))).alias("sql"), F.lit("foreign key condition").alias("description"), w["p"].alias("preference")))


def _cased(condition: Column) -> Column:
    """Aliases of a condition spelt as the query spells them: of two spellings, that in capitals."""
    side = lambda x: F.concat(F.when(F.contains(F.col("sql"), F.concat(F.upper(F.split(x, r"\.")[0]), F.lit("."))), F.upper(F.split(x, r"\.")[0])).otherwise(F.split(x, r"\.")[0]), F.lit("."), F.split(x, r"\.")[1])
    return F.concat(side(F.split(condition, " = ")[0]), F.lit(" = "), side(F.split(condition, " = ")[1]))


def _key_partners() -> Column:
    """For an unknown a.x in a.x = b.y: the query with a's column that a foreign key ties to b.y."""
    s, token = F.col("sql"), F.col("token")
    exact = F.concat(F.lit(r"\Q"), token, F.lit(r"\E"))
    other = F.lower(F.coalesce(*(F.get(F.regexp_extract_all(s, F.concat(F.lit(a), exact, F.lit(b)), F.lit(1)), F.lit(0)) for a, b in ((r"(?i)\b(\w+\.\w+) ?= ?", r"\b"), ("(?i)", r" ?= ?(\w+\.\w+)")))))
    table = lambda x: F.get(F.filter("sources", lambda y: y["a"] == F.lower(F.split(x, r"\.")[0])), F.lit(0))["t"]
    ahead = lambda k: (k["table_name"] == table(token)) & (k["target_table"] == table(other)) & (F.lower(k["target_column"]) == F.split(other, r"\.")[1])
    behind = lambda k: (k["table_name"] == table(other)) & (F.lower(k["column"]) == F.split(other, r"\.")[1]) & (k["target_table"] == table(token))
    fit = F.filter("links", lambda k: (k["preference"] == 0) & (ahead(k) | behind(k)))
    found = F.transform(fit, lambda k: F.regexp_replace(s, F.concat(F.lit("(?i)"), exact, F.lit(r"\b")), F.concat(F.split(token, r"\.")[0], F.lit("."), F.when(ahead(k), k["column"]).otherwise(k["target_column"]))))
    return F.when(token.contains(".") & other.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def links_of(catalog: DataFrame) -> DataFrame:
    """db_id, links: foreign keys (preference 0), and columns of one name that ends in "id" in two tables (preference 1)."""
    keys = catalog.select("db_id", F.lower("table_name").alias("table_name"), F.explode("foreign_keys").alias("k"))
    keys = keys.select("db_id", "table_name", F.col("k.column"), F.lower("k.target_table").alias("target_table"), "k.target_column", F.lit(0).alias("preference"))
    ids = catalog.select("db_id", F.lower("table_name").alias("table_name"), F.explode("columns.name").alias("column")).withColumn("_c", F.lower("column")).filter("_c like '%id' and _c <> 'id'")
    other = ids.select("db_id", "_c", F.col("table_name").alias("target_table"), F.col("column").alias("target_column"))
    shared = ids.join(other, ["db_id", "_c"]).filter("table_name < target_table").select("db_id", "table_name", "column", "target_table", "target_column", F.lit(1).alias("preference"))
    one = F.struct("table_name", "column", "target_table", "target_column", "preference")
    return keys.unionByName(shared).groupBy("db_id").agg(F.sort_array(F.collect_list(one)).cast(LINKS).alias("links"))


def _replaced(word: str | Column, new: Column, all_places: bool = True) -> Column:
    w = F.col(word) if isinstance(word, str) else word
    return F.regexp_replace(F.col("sql"), F.concat(F.lit(r"(?i)(?<![\w'])"), w, F.lit(r"(?![\w'])")), new)


def candidates(wrong: DataFrame, catalog: DataFrame, codes: set[str]) -> DataFrame:
    """id, candidate, description, preference for wrong queries (id, db_id, sql, code, token); only what their codes (all of them: ``codes``) call for is put together."""
    spark = wrong.sparkSession
    # dealt out again: the join gathers a database's queries
    own = spread(wrong.join(links_of(catalog), "db_id", "left")).withColumn("links", F.coalesce("links", F.array().cast(LINKS))).withColumn("sources", _sources())
    found = [own.select("id", F.explode(rewrites(codes)).alias("c")).select("id", F.regexp_replace("c.sql", r"upper:(\w+)\(", "$1(").alias("candidate"), "c.description", "c.preference")]
    names = F.regexp_replace("token", r"^.*\.", "")
    columns = catalog.select("db_id", "table_name", F.explode("columns.name").alias("option"))

    def add(rows: DataFrame, candidate: Column, what: str, preference: int) -> None:
        found.append(rows.select("id", candidate.alias("candidate"), F.lit(what).alias("description"), F.lit(preference).alias("preference")))

    if "SYN_ENGINE" in codes:  # misspelt keywords: words of the query near a keyword, that name nothing
        words = wrong.filter("code = 'SYN_ENGINE'").select("id", "db_id", "sql", F.explode(F.array_distinct(F.regexp_extract_all("sql", F.lit(r"\b([A-Za-z]{2,})\b"), F.lit(1)))).alias("word"))
        known = columns.select("db_id", F.lower("option").alias("_w")).unionByName(catalog.select("db_id", F.lower("table_name").alias("_w"))).distinct()
        words = words.join(known, (words["db_id"] == known["db_id"]) & (F.lower("word") == known["_w"]), "left_anti")
        near = keyword_matches(words).filter("place <= 2").select("word", "keyword")
        add(words.join(near, "word"), _replaced("word", F.when(F.col("keyword").isin("GROUP", "ORDER") & ~F.col("sql").rlike(r"(?i)\bBY\b"), F.concat("keyword", F.lit(" BY"))).otherwise(F.col("keyword"))), "keyword", -1)
    if "TAB_UNKNOWN" in codes:  # near names, and the table with most of the columns that the query names
        lost = wrong.filter("code = 'TAB_UNKNOWN'").withColumn("word", names)
        near = closest(lost.select("db_id", "word"), catalog.select("db_id", F.col("table_name").alias("option")), ["db_id"], cutoff=0.5)
        add(lost.join(near.select("db_id", "word", "option"), ["db_id", "word"]), _replaced("word", F.col("option")), "table", 0)
        words = lost.select("id", "db_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("sql", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)), F.lower))).alias("_w"))
        cover = words.join(columns.select("db_id", "table_name", F.lower("option").alias("_w")), ["db_id", "_w"]).groupBy("id", "table_name").agg(F.count("*").alias("_n"))
        cover = cover.groupBy("id").agg(F.min_by("table_name", F.struct(-F.col("_n"), "table_name")).alias("option"))
        add(lost.join(cover, "id"), _replaced("word", F.col("option")), "table with the columns used", 0)
    if "COL_UNKNOWN" in codes:  # near names of the table that the qualifier stands for, else of all tables of the query
        lost = own.filter("code = 'COL_UNKNOWN'").withColumn("word", names)
        of = F.when(F.col("token").contains("."), F.filter("sources", lambda x: x["a"] == F.lower(F.split("token", r"\.")[0]))).otherwise(F.col("sources"))
        pool = lost.select("id", "db_id", F.explode(F.array_distinct(F.transform(of, lambda x: x["t"]))).alias("_t")).join(columns.withColumn("_t", F.lower("table_name")), ["db_id", "_t"])
        near = closest(lost.select("id", "word"), pool.select("id", "option"), ["id"], cutoff=0.6)
        add(lost.join(near.select("id", "word", "option"), ["id", "word"]), _replaced("word", F.col("option")), "column", 0)
    if codes & {"COL_UNKNOWN", "AMB_COLUMN"}:  # other aliases of the query, for all places of the name or for one
        lost = own.filter("code in ('AMB_COLUMN', 'COL_UNKNOWN')").withColumn("alias", F.explode(F.array_distinct(F.transform("sources", lambda x: x["a"]))))
        alias = F.when(F.rlike("sql", F.concat(F.lit(r"\b"), F.upper("alias"), F.lit(r"\b"))), F.upper("alias")).otherwise(F.col("alias"))
        bare = F.concat(F.lit(r"(?i)(?<![\w.'])(?:\w+\.)?"), names, F.lit(r"(?![\w'(.])"))
        add(lost, F.regexp_replace("sql", bare, F.concat(alias, F.lit("."), names)), "qualify", 1)
        only = F.concat(F.lit(r"(?i)(?<![\w.'])"), names, F.lit(r"(?![\w'(.])"))
        add(lost.filter("code = 'AMB_COLUMN'"), F.regexp_replace("sql", only, F.concat(alias, F.lit("."), names)), "qualify", 0)
    if "SEM_FUNCTION" in codes:  # other names of functions, else near ones
        lost = wrong.filter("code = 'SEM_FUNCTION'").withColumn("word", F.lower("token"))
        known = spark.createDataFrame([(k, v) for k, v in SYNONYMS.items()], "word string, option string")
        near = closest(lost.select("word"), spark.createDataFrame([(f,) for f in FUNCTIONS], "option string"), []).select("word", "option")
        add(lost.join(known.unionByName(near.join(known, "word", "left_anti")), "word"), _replaced("word", F.col("option")), "function", 0)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.filter(F.col("candidate") != "").groupBy("id", "candidate").agg(F.min(F.struct("preference", "description")).alias("_p"))
    return every.select("id", "candidate", "_p.description", "_p.preference")


def _round(rows: DataFrame, path: str, number: int) -> DataFrame:
    at = f"{path}/round={number}"
    rows.write.mode("overwrite").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def repair(queries: DataFrame, catalog: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, db_id, original_query, repaired_query, success, remaining_error, steps.

    Queries that access policies forbid are never changed.  A query ends when correct, stuck or
    repeating, after as many steps as it has tokens at most; ``rounds`` sets a lower bound.
    """
    with interpreted(queries.sparkSession):
        return _repair(queries, catalog, rounds)


def _repair(queries: DataFrame, catalog: DataFrame, rounds: int | None) -> DataFrame:
    rank = F.create_map(*(F.lit(x) for p in (*PRIORITY.items(), ("CORRECT", 8)) for x in p))
    state = diagnose(queries, catalog).select(
        "id", "db_id", F.col("sql").alias("original_query"), normalize_query(F.col("sql")).alias("sql"), "policy", "error_class", "issues",
        F.array().cast("array<struct<error_class string, description string, before string, after string>>").alias("steps"), F.lit(False).alias("stuck"),
    )
    limit = F.size(F.regexp_extract_all(normalize_query(F.col("original_query")), F.lit(r"(\w+|\S)"), F.lit(1)))
    if rounds is not None:
        limit = F.least(limit, F.lit(rounds))
    ended = F.col("error_class").isin("CORRECT", "PERMISSION_DENIED") | F.col("stuck") | (F.size("steps") >= limit)
    # each round is a folder of its own, of the rows that were open before it; a row is final in the last one it is in
    path = os.path.join(folder(queries.sparkSession), f"repair-{uuid.uuid4().hex}")
    number, state = 0, _round(state.withColumn("open", ~ended), path, 0)
    while True:
        todo = state.filter("open")
        codes = {r["code"] for r in todo.select(F.get("issues", F.lit(0))["code"].alias("code")).distinct().collect()}
        if not codes:
            break
        wrong = todo.select("id", "db_id", F.regexp_replace("sql", r"\s+", " ").alias("sql"), F.get("issues", F.lit(0))["code"].alias("code"), F.get("issues", F.lit(0))["token"].alias("token"))
        options = written(candidates(wrong, catalog, codes), "candidates")
        base = todo.select("id", "db_id", "policy", F.col("sql").alias("before"), F.col("error_class").alias("was"), F.col("issues").alias("had"), "steps", "original_query")
        # written down: what follows reads it twice, and puts no plan upon the large one
        tried = tried_rows = written(diagnose(spread(options.join(base, "id")).select("id", "db_id", "policy", F.col("candidate").alias("sql"), "before", "was", "had", "steps", "original_query", "description", "preference"), catalog), "tried")
        tried = tried.filter(F.col("sql") != F.col("before"))
        gone = ~F.exists("issues", lambda x: (x["code"] == F.get("had", F.lit(0))["code"]) & x["token"].eqNullSafe(F.get("had", F.lit(0))["token"]) & (x["message"] == F.get("had", F.lit(0))["message"]))
        no_worse = (rank[F.col("error_class")] >= rank[F.col("was")]) | (F.col("error_class") == "CORRECT")
        # or what comes up was there before, only masked: it names words of the query as it was
        words = F.split(F.lower("before"), r"[^\w']+")
        unmasked = F.forall("issues", lambda x: (rank[x["error_class"]] >= rank[F.col("was")]) | F.coalesce(F.array_contains(words, F.lower(F.regexp_replace(x["token"], r"^.*\.", ""))), F.lit(False)))
        tried = tried.filter(gone & (no_worse | unmasked)).withColumn("_sound", no_worse)
        # what only unmasks comes after all that is sound
        urgent = (F.desc("_sound"), (F.col("error_class") != "CORRECT").cast("int"), F.col("preference"), -rank[F.col("error_class")], F.size("issues"))
        # sizes of edits, the dearest measure, only of those that nothing else tells apart
        level = tried.withColumn("_rn", F.rank().over(W.partitionBy("id").orderBy(*urgent))).filter("_rn = 1")
        best = level.withColumn("_size", edit_size(F.col("before"), F.col("sql"))).withColumn("_rn", F.row_number().over(W.partitionBy("id").orderBy("_size", "sql"))).filter("_rn = 1")
        best = best.filter(~F.exists("steps", lambda s: s["before"] == F.col("sql")))  # repeating: stuck
        step = F.struct(F.col("was").alias("error_class"), "description", "before", F.col("sql").alias("after"))
        best = best.select("id", "db_id", "original_query", "sql", "policy", "error_class", "issues", F.array_append("steps", step).alias("steps"), F.lit(False).alias("stuck"))
        best = best_rows = written(best, "best")  # read twice
        rest = todo.drop("open").join(best.select("id"), "id", "left_anti").withColumn("stuck", F.lit(True))
        number += 1
        state = _round(best.unionByName(rest.select(*best.columns)).withColumn("open", ~ended), path, number)
        discard(options)
        discard(tried_rows)
        discard(best_rows)
    state = queries.sparkSession.read.schema(state.schema).parquet(*(f"{path}/round={k}" for k in range(number + 1))).filter("not open")
    told = F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". ["), s["error_class"], F.lit("] "), s["description"]))
    sound = F.col("error_class") == "CORRECT"
    end = F.when(sound & (F.size("steps") > 0), "The repaired query passes all checks.").when(sound, "No errors detected; no changes needed.").otherwise(F.concat(F.lit("Remaining problem: "), F.get("issues", F.lit(0))["message"]))
    policy = F.when(F.col("error_class") == "PERMISSION_DENIED", "What a policy closes cannot be repaired: leave it out or ask for access.")
    explain = F.concat_ws("\n", told, end, policy)
    return state.select(
        "id", "db_id", "original_query", F.col("sql").alias("repaired_query"), (F.col("error_class") == "CORRECT").alias("success"),
        F.when(F.col("error_class") != "CORRECT", F.col("error_class")).alias("remaining_error"), "steps", explain.alias("explanation"),
    )
