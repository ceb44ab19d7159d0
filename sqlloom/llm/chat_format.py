r"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Template: ``### role: text</turn>\n`` for each turn.  Inside roles and texts
``\ # < :`` become ``\b \h \l \c`` (``:`` in roles only), so no control
string can arise from a text, and undoing it is four plain replacements.

Each assistant turn becomes an example: the prompt holds all preceding turns
and the opening of its own, the target (alone under the loss mask) is its
escaped text.  What follows the last assistant turn is kept as ``tail`` of a
final example without target, so the whole conversation can be read back.

Defined results: null texts and roles count as empty; turns sort by turn,
then role, then text (null turns first; repeated rows stay); conversations
without an assistant give one example without target; an empty table gives
an empty table; other columns are ignored.  A conversation is one row of
text: its own length, not the corpus, bounds the memory of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
#: What is escaped, in the order of escaping; undone in reverse order.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column, role: bool = False) -> Column:
    for a, b in ESCAPES + ((":", "\\c"),) * role:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in ((":", "\\c"), *reversed(ESCAPES)):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, and ``examples``: array<target_start, target_chars> (code points, from 0), one for each assistant turn and one of no chars at the end."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_r"))
    c = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    c = c.select("conv_id", F.transform("_r", lambda r: F.struct((r.role == TRAINED).alias("trained"), F.concat(F.lit(OPEN), escape(r.role, True), F.lit(MID)).alias("head"), escape(r.text).alias("body"))).alias("_t"))
    c = c.withColumn("formatted", F.array_join(F.transform("_t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""))
    at = F.aggregate(
        F.transform("_t", lambda t: F.struct(t["trained"].alias("trained"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<target_start int, target_chars int>>)").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + t["head"] + t["body"] + len(CLOSE)).alias("at"),
            F.when(t["trained"], F.array_append(s["spans"], F.struct((s["at"] + t["head"]).alias("target_start"), t["body"].alias("target_chars")))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return c.withColumn("examples", at["spans"]).drop("_t")


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, example (from 0), prompt, target, tail (after the last target, else null).

    A conversation without a trained turn gives one row with an empty target.
    """
    none = F.array(F.struct(F.lit(0).alias("target_start"), F.lit(0).alias("target_chars")))
    spans = F.when(F.size("examples") > 0, F.col("examples")).otherwise(none)
    e = formatted.select("conv_id", "formatted", F.size(spans).alias("_n"), F.posexplode(spans).alias("example", "_e"))
    end = F.col("_e.target_start") + F.col("_e.target_chars")
    return e.select(
        "conv_id", "example",
        F.substring("formatted", F.lit(1), F.col("_e.target_start")).alias("prompt"),
        F.substring("formatted", F.col("_e.target_start") + 1, F.col("_e.target_chars")).alias("target"),
        F.when(F.col("example") == F.col("_n") - 1, F.substring("formatted", end + 1, F.length("formatted") - end)).alias("tail"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """From the examples alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    Only the last example of a conversation carries its prompt into the shuffle.
    """
    e = examples.select("conv_id", F.struct("example", "target").alias("_t"), F.when(F.col("tail").isNotNull(), F.concat("prompt", "target", "tail")).alias("_f"))
    e = e.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_t"), F.max("_f").alias("_f"))
    e = e.withColumn("_loss", unescape(F.array_join(F.transform("_t", lambda t: t["target"]), "")))
    parts = F.filter(F.split("_f", CLOSE), lambda x: x != "")
    turns = F.transform(parts, lambda p: F.concat(
        unescape(F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), MID, 1)), F.lit("\n"),
        unescape(F.substring(p, F.length(F.substring_index(p, MID, 1)) + len(MID) + 1, F.length(p))), F.lit("\n")))
    e = e.withColumn("_turns", turns)
    return e.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join("_turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("_f").cast("long").alias("formatted_chars"), F.size("_t").cast("long").alias("n_examples"),
    )


def chat_digests(turns: DataFrame) -> DataFrame:
    return read_back(expand_examples(format_conversations(turns)))
