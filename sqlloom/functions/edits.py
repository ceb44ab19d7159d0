"""Single edits of a text at each place where a pattern occurs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


EDITS = "array<struct<pattern: string, at: int, new: string>>"


def _found(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))


def _parts(text: Column, pattern: Column) -> Column:
    """What is between the matches, and the matches, in turn."""
    return F.flatten(F.zip_with(F.split(text, pattern, -1), _found(text, pattern), lambda a, b: F.filter(F.array(a, b), lambda x: x.isNotNull())))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), an array; the value is worked out once, however often it is used."""
    return F.flatten(F.transform(F.array(value), use))


def _spliced(parts: Column, at: Column, new: Column) -> Column:
    """The text with the match of this place replaced."""
    return F.array_join(F.array(F.array_join(F.slice(parts, F.lit(1), 2 * at + 1), ""), new, F.array_join(F.slice(parts, 2 * at + 3, F.size(parts)), "")), "")


def each(text: Column, pattern: str, new: Callable[[Column], Column] | str, most: int | None = None) -> Column:
    """array<string>: for every match (the first ``most``), the text with that match alone replaced; unchanged results are left out."""
    make = (lambda x: F.lit(new)) if isinstance(new, str) else new

    def edited(parts: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1)
        if most is not None:
            places = F.slice(places, 1, most)
        texts = F.transform(places, lambda i: _spliced(parts, i, make(F.get(parts, 2 * i + 1))))
        return F.when(F.size(parts) > 1, texts).otherwise(F.array().cast("array<string>"))

    return F.filter(_once(_parts(text, F.lit(pattern)), edited), lambda x: x != text)


def edits(text: Column, pattern: str, *new: Callable[[Column], Column] | str) -> Column:
    """EDITS: for each of ``new`` what every match becomes, matches that stay as they are left out.

    ``edited`` makes the text of one: where one of many is drawn, the others' texts need not be made.
    """

    def changed(found: Column, to: Callable[[Column], Column] | str) -> Column:
        made = lambda x, i: F.struct(F.lit(pattern).alias("pattern"), i.alias("at"), (F.lit(to) if isinstance(to, str) else to(x)).alias("new"))
        return F.filter(F.transform(found, made), lambda e: e["new"] != F.get(found, e["at"]))

    return _once(_found(text, F.lit(pattern)), lambda found: F.concat(*(changed(found, to) for to in new)))


def rewritten(text: Column, new: Column) -> Column:
    """EDITS of at most one: the whole text becomes another, if it is another."""
    return F.filter(F.array(F.struct(F.lit(None).cast("string").alias("pattern"), F.lit(-1).alias("at"), new.alias("new"))), lambda e: e["new"] != text)


def edited(text: Column, edit: Column) -> Column:
    """The text that one of EDITS makes."""
    return F.when(edit["pattern"].isNull(), edit["new"]).otherwise(_spliced(_parts(text, edit["pattern"]), edit["at"], edit["new"]))


def once(text: Column, pattern: str, replacement: str) -> Column:
    """array<string> of at most one: the text with all matches replaced, if that changes it."""
    out = F.regexp_replace(text, pattern, replacement)
    return F.filter(F.array(out), lambda x: x != text)


def tidy(text: Column) -> Column:
    """Blanks as one writes them: none doubled, none before a comma or closing parenthesis."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" (?=[,)])", ""))
