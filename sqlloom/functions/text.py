"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: text that looks like a number.
NUMERIC = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"
#: Parts of a declared type, in the order in which they decide.
TYPE_PARTS = (
    ("boolean", r"bool"),
    ("number", r"int|real|num|dec|float|double|money|serial|bit"),
    ("text", r"char|text|clob|string|uuid|json|enum"),
)
COARSE = ("number", "text", "time", "boolean", "other")


def normalize_query(q: Column) -> Column:
    """Trims white space and all closing semicolons."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(q, F.lit("")), r"^\s+", ""), r"[\s;]+$", "")


def dedupe_key(q: Column) -> Column:
    """Trimmed, without closing semicolons, lower case, runs of white space as one blank."""
    trimmed = F.regexp_replace(F.regexp_replace(q, r"^\s+|\s+$", ""), r";+$", "")
    return F.regexp_replace(F.lower(trimmed), r"\s+", " ")


def extract_sql(answer: Column) -> Column:
    """The first statement of a model's answer: inside a fence if there is one, without a leading ``sql:``, up to a semicolon, on one line."""
    fence = r"(?is)```(?:sql)?\s*(.*?)```"
    body = F.when(answer.rlike(fence), F.regexp_extract(answer, fence, 1)).otherwise(answer)
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    body = F.regexp_replace(body, r"(?i)^\s*(sql|sqlite)\s*[:\n]", "")
    return F.regexp_replace(F.regexp_replace(F.split_part(body, F.lit(";"), F.lit(1)), r"\s+", " "), r"^\s+|\s+$", "")


def normalize_type(declared: Column, strict: bool = False) -> Column:
    """The coarse type of a declared one.  strict: ENUM is text, INTERVAL time and POINT other, instead of numbers by their letters."""
    t = F.lower(F.regexp_replace(F.coalesce(declared, F.lit("")), r"^\s+|\s+$", ""))
    out = F.when(t == "", "other").when(t.isin(*COARSE), t)
    if strict:
        out = out.when(t.startswith("enum"), "text").when(t.startswith("interval"), "time").when(t.startswith("point"), "other")
    name, parts = TYPE_PARTS[0]
    out = out.when(t.rlike(parts), name).when(t.rlike("date|time|year") & ~t.contains("int"), "time")
    for name, parts in TYPE_PARTS[1:]:
        out = out.when(t.rlike(parts), name)
    return out.otherwise("other")


def quote_ident(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def toggle_plural(w: Column) -> Column:
    low = F.lower(w)
    left = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(low.endswith("ies") & (F.length(w) > 4), F.concat(left(3), F.lit("y")))
        .when(low.endswith("ses") | low.endswith("xes"), left(2))
        .when(low.endswith("s") & ~low.endswith("ss"), left(1))
        .when(low.endswith("y") & (F.length(w) > 2) & ~F.substring(low, F.length(w) - 1, F.lit(1)).isin(*"aeiou"), F.concat(left(1), F.lit("ies")))
        .otherwise(F.concat(w, F.lit("s")))
    )


def is_numeric_text(x: Column) -> Column:
    return x.rlike(NUMERIC)


def escape_like(x: Column) -> Column:
    r"""``\``, ``%`` and ``_`` as themselves in a LIKE pattern."""
    return F.regexp_replace(x, r"([\\%_])", r"\\$1")


def printable_number(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def printable_bytes(b: Column) -> Column:
    return F.concat(F.lit("<blob "), F.length(b).cast("string"), F.lit(" bytes "), F.hex(F.substring(b, 1, 16)), F.lit(">"))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(100 * x, digits), F.lit("%"))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_number(ms / 1000, 1), F.lit(" s")))


def relative_time(at: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    whole = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3600, whole(60, " min ago")).when(s < 86400, whole(3600, " h ago")).otherwise(whole(86400, " d ago"))


def ddl(name: Column, columns: Column, primary_keys: Column, foreign_keys: Column) -> Column:
    """CREATE TABLE text of a catalog row; a single primary key is declared in its column's line."""
    one = F.size(primary_keys) == 1
    lines = F.transform(columns, lambda c: F.concat(quote_ident(c["name"]), F.lit(" "), c["raw_type"], F.when(one & F.array_contains(primary_keys, c["name"]), " PRIMARY KEY").otherwise("")))
    key = F.when(F.size(primary_keys) > 1, F.array(F.concat(F.lit("PRIMARY KEY ("), F.array_join(F.transform(primary_keys, quote_ident), ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    links = F.transform(foreign_keys, lambda k: F.concat(F.lit("FOREIGN KEY ("), quote_ident(k["column"]), F.lit(") REFERENCES "), quote_ident(k["target_table"]), F.lit("("), quote_ident(k["target_column"]), F.lit(")")))
    return F.concat(F.lit("CREATE TABLE "), quote_ident(name), F.lit(" (\n  "), F.array_join(F.concat(lines, key, links), ",\n  "), F.lit("\n)"))


def csv_cell(x: Column) -> Column:
    """A cell of the exported CSV: null as nothing, quoted where it must be."""
    q = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.isNull(), "").when(x.rlike('[",\\r\\n]'), q).otherwise(x)


def serialised_schema(table: Column, columns: Column, mentioned: Column) -> Column:
    """A table as a model reads it: with its columns where the question mentions it, else by name."""
    return F.when(mentioned, F.concat(table, F.lit("("), F.array_join(F.transform(columns, lambda c: F.concat(c["name"], F.lit(" "), c["type"])), ", "), F.lit(")"))).otherwise(table)


def canonical_form(q: Column) -> Column:
    """A query's structure: lower case, strings as '?', numbers as 0, aliases of the i-th table as t<i>, single blanks.  Two queries match exactly where these are equal."""
    plain = F.regexp_replace(F.lower(normalize_query(q)), r"'[^']*(?:''[^']*)*'", "'?'")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<![\w.'])\d+(?:\.\d+)?(?![\w'])", "0"), r"\s+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r" ?([(),=<>!]+) ?", " $1 "), r"\s+", " ")
    behind = r"\b(?:from|join|,) (\w+)(?: as)? (?!(?:on|where|join|group|order|using|left|inner|cross|natural|limit|having|union|intersect|except|as)\b)(\w+)"
    # all at once, word by word: a new name is never taken for an alias again; of an alias that is given twice the first place counts
    found = lambda p: F.struct(F.regexp_extract_all(p, F.lit(behind), F.lit(2)).alias("aliases"), F.regexp_extract_all(p, F.lit(r"('\?'|\w+|[^\w']+|')"), F.lit(1)).alias("pieces"))

    def renamed_in(aliases: Column, pieces: Column) -> Column:
        new = lambda x: F.concat(F.lit("t"), F.array_position(aliases, x).cast("string"))
        return F.array_join(F.transform(pieces, lambda x, i: F.when(F.array_contains(aliases, x) & ~F.coalesce(F.get(pieces, i - 1).endswith("."), F.lit(False)), new(x)).otherwise(x)), "")

    # each step is the one element of an array: a lambda's variable is worked out once, an expression in a lambda at every element
    once = F.transform(F.transform(F.array(plain), found), lambda f: renamed_in(f["aliases"], f["pieces"]))
    renamed = F.element_at(once, 1)
    # "FROM x AS t1" and "FROM x t1" are the same
    return F.trim(F.regexp_replace(renamed, r"\b(from|join|,) (\w+) as (t\d+)\b", "$1 $2 $3"))
