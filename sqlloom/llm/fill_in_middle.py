r"""Fill-in-middle transformation by escaped marker injection.

1. A backslash and the delimiter are escaped (``\b``, ``\d``), so that the delimiter is free.
2. ``regexp_replace`` appends the delimiter to each unit: a code point, a word with the white
   space after it, or a line.  Counting delimiters counts units.
3. ``substring_index`` extracts the units up to, between and after two ranks, which are drawn by
   hashing the id; delimiters go, escapes are undone, and the parts are put together with markers.

All of it are column expressions; rows are independent, so nothing is shuffled.  ``restore`` reads a text
back from its output and form.

Defined results: a null text counts as empty and stays plain, as does a text that contains a marker; a null id
draws as an empty one; repeated rows give equal results; of tied ranks the middle is empty; a very long text needs memory for its
marked form (up to three times its size); an empty table gives an empty table; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

DELIMITER = "\x1f"
MARKERS = ("<P>", "<S>", "<M>")
#: Units, as patterns over escaped texts; each covers any text.  No quantifier stands on a group: Java would recurse.
UNITS = {"character": r"\\[bd]|[^\\]", "word": r"\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(DELIMITER), F.lit("\\d"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\d"), F.lit(DELIMITER)), F.lit("\\b"), F.lit("\\"))


def marked(text: Column, unit: str = "character") -> Column:
    """The escaped text with the delimiter after each unit."""
    return F.regexp_replace(escaped(text), f"({UNITS[unit]})", "$1" + DELIMITER)


def _ranks(marks: Column, count: Column) -> Column:
    """The first ``count`` delimited parts, or the last -count."""
    return F.call_function("substring_index", marks, F.lit(DELIMITER), count.cast("int"))


def _part(marks: Column) -> Column:
    return unescaped(F.replace(marks, F.lit(DELIMITER), F.lit("")))


def draws(doc_id: str, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers: the first digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "character", plain: int = 10, spm: int = 20, markers: tuple[str, str, str] = MARKERS, seed: str = "1") -> DataFrame:
    """doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output.

    ``plain`` and ``spm`` are per cents: of all documents left as they are, and of the others with the suffix first.
    Markers must differ, and none may begin within another: with ``<P>`` and its like a text without markers is read back exactly.
    """
    p, s, m = markers
    h1, h2, h3, h4 = draws("doc_id", seed)
    d = docs.select("doc_id", whole().alias("text"), *(h.alias(f"h{i}") for i, h in enumerate((h1, h2, h3, h4), 1)))
    held = F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m)
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    # of plain rows only the units are counted
    d = d.withColumn("form", form).withColumn("_marks", marked(F.col("text"), unit))
    n = F.length("_marks") - F.length(F.replace(F.col("_marks"), F.lit(DELIMITER), F.lit("")))
    d = d.withColumn("n", n.cast("long"))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    d = d.withColumn("_a", F.least(first, second)).withColumn("_b", F.greatest(first, second))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    d = d.select(
        "doc_id", "text", "n", "form",
        cut(_part(_ranks(F.col("_marks"), F.col("_a")))).alias("prefix"),
        cut(_part(_ranks(_ranks(F.col("_marks"), F.col("_b")), F.col("_a") - F.col("_b")))).alias("middle"),
        cut(_part(_ranks(F.col("_marks"), F.col("_b") - F.col("n") - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(p), F.col("prefix"), F.lit(s), F.col("suffix"), F.lit(m), F.col("middle"))
    turned = F.concat(F.lit(s), F.col("suffix"), F.lit(p), F.col("prefix"), F.lit(m), F.col("middle"))
    return d.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(turned))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = markers

    def text(head: str, mid: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(head) + 1), F.length(output))
        rest = F.substring_index(body, mid, -1)
        return F.substring_index(body, mid, 1), F.substring_index(rest, m, 1), F.substring_index(rest, m, -1)

    prefix, suffix, middle = text(p, s)
    suffix2, prefix2, middle2 = text(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle2, suffix2))


def middle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    d = fill_in_middle(docs)
    return d.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
