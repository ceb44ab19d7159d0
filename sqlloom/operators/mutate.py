"""Corpora of wrong queries by controlled mutation of correct ones.

Over-generate, verify, then pick: every mutation gives candidates as a column
expression, one candidate of each (query, mutation) is drawn by a hash, the
analyzer keeps those whose verdict is the mutation's class, and quotas choose
among them.  Nothing depends on the order or partitioning of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.built import built_once
from ..functions.edits import EDITS, each, edited, edits, rewritten, tidy
from ..functions.text import dedupe_key, toggle_plural
from ..plans.stages import interpreted, written
from .corpus import draw, quota, source_cap
from .diagnose import diagnose

KEYWORD = r"(?i)\b(?:SELECT|FROM|WHERE|GROUP|ORDER|HAVING|JOIN|LIMIT)\b"
NUMBER, STRING = r"(?<=[=<>]\s)\d+(?:\.\d+)?", r"(?<=[=<>]\s)'[^']*'"
TABLE, COLUMN = r"(?i)(?<=\b(?:FROM|JOIN)\s)[A-Za-z_]\w*", r"(?i)(?<=\bSELECT\s|\.|, )[A-Za-z_]\w*(?=[ ,])"
#: Misspelt function names.
FUNCTION_TYPOS = {"count": "cnt", "avg": "average", "max": "maximum", "min": "minimum", "sum": "summ"}


#: Letters, and the keys to their right.
LETTERS, RIGHT = "qwertyuiopasdfghjklzxcvbnmQWERTYUIOPASDFGHJKLZXCVBNM", "wertyuioposdfghjklaxcvbnmzWERTYUIOPOSDFGHJKLAXCVBNMZ"


def _slips() -> tuple[Callable[[Column], Column], ...]:
    """Slips in a word's second letter: swapped with the next, left out, doubled, or the key beside it."""
    first, second, third = (lambda w, k=k: F.substring(w, k, 1) for k in (1, 2, 3))
    rest = lambda w, k: F.substring(w, F.lit(k), F.length(w))
    return (
        lambda w: F.concat(first(w), third(w), second(w), rest(w, 4)), lambda w: F.concat(first(w), rest(w, 3)),
        lambda w: F.concat(first(w), second(w), rest(w, 2)), lambda w: F.concat(first(w), F.translate(second(w), LETTERS, RIGHT), rest(w, 3)),
    )


def _column_variants() -> tuple[Callable[[Column], Column], ...]:
    """A column under a name that it does not have: another number, a part more, less or elsewhere, an id."""
    parts = lambda w: F.split(w, "_")
    return (
        toggle_plural, lambda w: F.concat(w, F.lit("_name")), lambda w: F.concat(w, F.lit("_id")),
        lambda w: F.replace(w, F.lit("_"), F.lit("")), lambda w: F.array_join(F.reverse(parts(w)), "_"),
    )


def _once(s: Column, pattern: str, replacement: str) -> Column:
    """The text with all matches replaced."""
    return rewritten(s, F.regexp_replace(s, pattern, replacement))


def _function_typos(sql: Column) -> Column:
    return F.concat(*(_once(sql, rf"(?i)\b{f}\s*\(", f"{t}(") for f, t in FUNCTION_TYPOS.items()))


#: name: (class, weight, edits).  The weights are relative frequencies of a draw.
MUTATIONS = {
    "syn_drop_comma": ("SYNTAX_ERROR", 1.0, lambda s: edits(s, ",", "")),
    "syn_drop_keyword": ("SYNTAX_ERROR", 1.2, lambda s: edits(s, r"(?i)\b(?:FROM|WHERE|ON|SELECT|HAVING)\b ?", "")),
    "syn_keyword_typo": ("SYNTAX_ERROR", 1.5, lambda s: edits(s, KEYWORD, *_slips())),
    "syn_split_by": ("SYNTAX_ERROR", 0.5, lambda s: edits(s, r"(?i)(?<=\b(?:GROUP|ORDER)) BY\b", "")),
    "syn_parenthesis": ("SYNTAX_ERROR", 1.0, lambda s: F.concat(edits(s, r"[()]", ""), edits(s, r"(?<=[ ,])(?=[a-z_]\w*[ ,)])", "("))),
    "syn_unclosed_quote": ("SYNTAX_ERROR", 0.7, lambda s: edits(s, r"'[^']*'", lambda x: F.substring(x, F.lit(1), F.length(x) - 1))),
    "syn_dangling_operator": ("SYNTAX_ERROR", 1.2, lambda s: F.concat(edits(s, r"(?i)\bWHERE\b", "WHERE AND"), edits(s, f"{NUMBER}|{STRING}", ""), edits(s, r"(?<=[\w.] )(?:=|<>|<=|>=|<|>) (?=[\w'])", ""))),
    "syn_trailing_comma": ("SYNTAX_ERROR", 0.6, lambda s: edits(s, r"(?i) FROM\b", ", FROM")),
    "syn_clause_order": ("SYNTAX_ERROR", 0.6, lambda s: _once(s, r"(?is)^(.*?) (WHERE .*?) ((?:GROUP|ORDER) BY .*)$", "$1 $3 $2")),
    "syn_duplicate_keyword": ("SYNTAX_ERROR", 0.4, lambda s: edits(s, r"(?i)\b(?:SELECT|FROM|WHERE)\b", lambda x: F.concat(x, F.lit(" "), x))),
    "tab_rename": ("UNKNOWN_TABLE", 1.0, lambda s: edits(s, TABLE, toggle_plural, *_slips(), lambda x: F.concat(F.lit("tbl_"), x), lambda x: F.concat(x, F.lit("_info")))),
    "col_rename": ("UNKNOWN_COLUMN", 1.0, lambda s: edits(s, COLUMN, *_column_variants(), *_slips())),
    "dt_literal": ("DATATYPE_MISMATCH", 1.5, lambda s: F.concat(edits(s, NUMBER, "'high'"), edits(s, STRING, "5"))),
    "dt_aggregate": ("DATATYPE_MISMATCH", 1.0, lambda s: edits(s, r"(?i)(?<=^SELECT )(?:\w+\.)?[a-z_]\w*(?=[ ,])", *(lambda x, f=f: F.concat(F.lit(f + "("), x, F.lit(")")) for f in ("avg", "sum")))),
    "dt_predicate": ("DATATYPE_MISMATCH", 0.8, lambda s: _once(s, r"(?i)\bWHERE ([\w.]+) ", "WHERE $1 = 'unknown' AND $1 ")),
    "amb_unqualify": ("AMBIGUOUS_REFERENCE", 2.0, lambda s: edits(s, r"\b[A-Za-z_]\w*\.(?=[A-Za-z_])", "")),
    "amb_duplicate_alias": ("AMBIGUOUS_REFERENCE", 1.0, lambda s: _once(s, r"(?is)(\bAS )(\w+)( .*?\bAS )(\w+)", "$1$2$3$2")),
    "amb_self_join": ("AMBIGUOUS_REFERENCE", 0.4, lambda s: F.concat(*(_once(s, r"(?i)\bFROM (\w+)(?= WHERE| GROUP| ORDER| LIMIT|$)", to) for to in ("FROM $1 JOIN $1", "FROM $1 AS a JOIN $1 AS a")))),
    "sem_null_compare": ("SEMANTIC_ERROR", 1.2, lambda s: edits(s, r"(?<== )(?:'[^']*'|\d+)", "NULL")),
    "sem_having_to_where": ("SEMANTIC_ERROR", 1.0, lambda s: _once(s, r"(?is) (GROUP BY .*?) HAVING (.*?)(?= ORDER BY| LIMIT|$)", " WHERE $2 $1")),
    "sem_aggregate_in_where": ("SEMANTIC_ERROR", 1.0, lambda s: F.concat(edits(s, r"(?i)\bWHERE\b", "WHERE count(*) > 1 AND"), _once(s, r"(?i)\(SELECT ((?:avg|max|min|sum|count)\([^()]*\)) FROM [^()]*\)", "$1"))),
    "sem_drop_group_by": ("SEMANTIC_ERROR", 1.0, lambda s: _once(s, r"(?is) GROUP BY .*?(?= HAVING| ORDER BY| LIMIT|$)", "")),
    "sem_ungrouped_column": ("SEMANTIC_ERROR", 1.0, lambda s: _once(s, r"(?is)^SELECT ((?:[\w.]+, )?)(.*?) (FROM .*? GROUP BY .*)$", "SELECT *, $1$2 $3")),
    "sem_drop_join_condition": ("SEMANTIC_ERROR", 1.0, lambda s: edits(s, r"(?i) ON [\w.]+ = [\w.]+", "")),
    "sem_order_position": ("SEMANTIC_ERROR", 0.4, lambda s: F.concat(edits(s, r"(?i)(?<=\bORDER BY )[\w.]+", "9"), F.when(~s.rlike(r"(?i)\b(order by|limit)\b"), rewritten(s, F.concat(s, F.lit(" ORDER BY 7")))).otherwise(F.array().cast(EDITS)))),
    "sem_set_op_arity": ("SEMANTIC_ERROR", 0.6, lambda s: edits(s, r"(?i)\b(?:UNION|INTERSECT|EXCEPT) SELECT ", lambda x: F.concat(x, F.lit("1, ")))),
    "sem_subquery_arity": ("SEMANTIC_ERROR", 0.5, lambda s: edits(s, r"(?i)\bIN \(SELECT ", lambda x: F.concat(x, F.lit("1, ")))),
    "sem_function_typo": ("SEMANTIC_ERROR", 1.0, _function_typos),
}


def augment_surface(sql: Column, *seed: Column) -> Column:
    """Keyword case, runs of blanks and a closing semicolon, by draws; never changes a verdict."""
    d = draw(*seed)
    digit = lambda k: F.conv(F.substring(d, k, 1), 16, 10).cast("int")
    cased = F.when(digit(1) < 6, sql).when(digit(1) < 11, _keywords(sql, F.lower)).otherwise(_keywords(sql, F.upper))
    spaced = F.when(digit(2) < 8, F.regexp_replace(cased, r" (?=FROM |WHERE |from |where )", "  ")).otherwise(cased)
    return F.when(digit(3) < 2, F.concat(spaced, F.lit(";"))).otherwise(spaced)


def _keywords(sql: Column, case) -> Column:
    """Keywords outside of string literals in the given case."""
    for k in ("SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY", "HAVING", "JOIN", "LIMIT", "AND", "OR", "AS", "ON", "DESC"):
        sql = F.regexp_replace(sql, F.lit(rf"(?i)\b{k}\b(?=(?:[^']*'[^']*')*[^']*$)"), case(F.lit(k)))
    return sql


def perturb_literals(sql: Column, *seed: Column) -> Column:
    """A number after a comparison becomes another one; LIMIT and positions stay."""
    shift = F.conv(F.substring(draw(*seed), 1, 2), 16, 10).cast("int") % 9 + 1
    options = each(sql, NUMBER, lambda x: F.when(x.contains("."), F.concat((x.cast("double") + shift).cast("string"))).otherwise((x.cast("long") + shift).cast("string")))
    return F.coalesce(F.when(F.size(options) > 0, options[0]), sql)


def rename_aliases(sql: Column, pool: str = "x") -> Column:
    """T1, T2 ... become x1, x2 ... throughout."""
    return F.regexp_replace(sql, r"\bT(\d)\b", f"{pool}$1")


#: Words for a text where the data have none.
FILLERS = ("unknown", "high", "large", "none", "red", "north", "alpha")


def random_text(seen: Column, *seed: Column) -> Column:
    """A text value: by a draw, in seven of ten cases one of those seen (array), else a filler; seen values that look like numbers do not count."""
    d = draw(*seed)
    number = lambda k: F.conv(F.substring(d, k, 4), 16, 10).cast("int")
    real, fillers = F.filter(seen, lambda x: (x != "") & ~x.rlike(r"^[-+.\d\s]+$")), F.array(*map(F.lit, FILLERS))
    return F.when((number(1) % 10 < 7) & (F.size(real) > 0), F.get(real, number(5) % F.size(real))).otherwise(F.get(fillers, number(9) % len(FILLERS)))


def surface(sql: Column, *seed: Column) -> Column:
    """A correct query in another dress: literals moved and aliases renamed in three of ten cases each, keywords and blanks by draws."""
    d = draw(*seed, F.lit("surface"))
    chance = lambda k: F.conv(F.substring(d, k, 4), 16, 10).cast("int") % 10 < 3
    moved = F.when(chance(1), perturb_literals(sql, *seed)).otherwise(sql)
    pools = F.when(chance(9), rename_aliases(moved, "q")).when(chance(13), rename_aliases(moved, "tbl")).otherwise(rename_aliases(moved))
    return augment_surface(F.when(chance(5), pools).otherwise(moved), *seed)


@built_once
def _candidates() -> Column:
    """array<struct<mutation, target, weight, options>> for the column sql."""
    return F.array(*(F.struct(F.lit(name).alias("mutation"), F.lit(c).alias("target"), F.lit(w).alias("weight"), make(F.col("sql")).alias("options")) for name, (c, w, make) in MUTATIONS.items()))


def mutants(queries: DataFrame, seed: int = 42) -> DataFrame:
    """queries (db_id, sql) x mutations: db_id, source_sql, mutation, target, weight, sql; one drawn candidate of each pair."""
    at = lambda m: F.conv(F.substring(draw(F.lit(seed), F.col("db_id"), F.col("sql"), m["mutation"]), 1, 8), 16, 10).cast("long") % F.size(m["options"])
    drawn = F.transform(F.filter(_candidates(), lambda m: F.size(m["options"]) > 0), lambda m: F.struct(m["mutation"], m["target"], m["weight"], F.get(m["options"], at(m).cast("int")).alias("edit")))
    m = queries.select("db_id", F.col("sql").alias("source_sql"), F.explode(drawn).alias("_m")).select("db_id", "source_sql", "_m.*")
    return m.select("db_id", "source_sql", "mutation", "target", "weight", tidy(edited(F.col("source_sql"), F.col("edit"))).alias("sql"))


def build_corpus(correct: DataFrame, catalog: DataFrame, per_label: int, cap: int | None = None, seed: int = 42) -> DataFrame:
    """db_id, sql, label, source_sql, mutation: verified mutants and correct queries, no key twice, quotas by label, at most ``cap`` mutants of one source.

    For each source and label the mutations stand in the order of weighted draws without replacement; the first that
    comes out with that label is taken.
    """
    with interpreted(correct.sparkSession):
        return _build_corpus(correct, catalog, per_label, cap, seed)


def _build_corpus(correct: DataFrame, catalog: DataFrame, per_label: int, cap: int | None, seed: int) -> DataFrame:
    m = mutants(correct, seed)
    c = correct.select("db_id", F.col("sql").alias("source_sql"), F.lit(None).cast("string").alias("mutation"), F.lit("CORRECT").alias("target"), F.lit(1.0).alias("weight"), surface(F.col("sql"), F.lit(seed), F.col("sql")).alias("sql"))
    checked = written(diagnose(m.unionByName(c).withColumn("id", F.xxhash64("db_id", "source_sql", "mutation")), catalog).filter("error_class = target").select(*m.columns), "mutants")
    u = (F.conv(F.substring(draw(F.lit(seed), F.lit("order"), "db_id", "source_sql", "mutation"), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    turn = F.struct(-F.log(u) / F.col("weight"), F.col("mutation"))
    first = checked.groupBy("db_id", "source_sql", "target").agg(F.min_by(F.struct("sql", "mutation"), turn).alias("_m")).select("db_id", "source_sql", "target", "_m.*")
    one = first.withColumn("_k", dedupe_key(F.col("sql"))).groupBy("_k").agg(F.min_by(F.struct("db_id", "sql", F.col("target").alias("label"), "source_sql", "mutation"), F.struct("source_sql", "mutation")).alias("_r")).select("_r.*")
    if cap:
        one = source_cap(one, "source_sql", cap, "sql", seed=seed).drop("pick")
    return written(quota(one, "label", per_label, "db_id", "sql", seed=seed).drop("pick"), "corpus")


def yields(correct: DataFrame, catalog: DataFrame, seed: int = 42) -> DataFrame:
    """mutation, made, verified: how many mutants of each kind have the verdict they are meant to have."""
    checked = diagnose(mutants(correct, seed).withColumn("id", F.xxhash64("source_sql", "mutation")), catalog)
    return checked.groupBy("mutation").agg(F.count("*").alias("made"), F.count_if(F.col("error_class") == F.col("target")).alias("verified"))
