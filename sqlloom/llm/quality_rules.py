"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes +1 (good), -1 (bad) or abstains (0).  Expectation-maximisation
over the counts of vote patterns (at most 3 ** number of rules rows, whatever
the corpus size) estimates how often each rule votes so on good and on bad texts
and the share of good texts; the posterior probability of "good" decides.

Defined results: a null text counts as empty; an empty text has zero words,
fails the base rules and is not kept; equal texts get equal results, so
repeated rows and ids each give a row; a posterior of exactly 0.5 keeps; a very
long text is one row of arrays over its words, bounded by its own length; an
empty table gives an empty table; columns other than ``doc_id`` and ``text``
are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, shared_dir, whole, words, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MARKS, CLOSERS = ".,;:!?…。、，！？；：؟،؛।", "\"'”’»)]"
#: What the rules are taken to do before any counting, by class and vote: where EM starts, which gives the classes their meaning.
#: BELIEF is how many rows that weighs afterwards, as a share of all: so little that the rows decide.
START = {"good": {-1: 0.001, 0: 0.15, 1: 0.849}, "bad": {-1: 0.3, 0: 0.15, 1: 0.55}}
BELIEF, PRIOR = 0.01, 0.85
RULES = ("length", "symbols", "lines", "repeats", "word_length", "capitals", "exclaims", "marks", "letters")


def _pairs(a: Column, b: Column, n: Column, shift: int) -> Column:
    """Hashes of every element with the one ``shift`` places later; n: how many such pairs there are."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), lambda x, y: F.xxhash64(x, y))


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at; everything stays in one row, nothing is exploded or shuffled.

    Windows of 8 words are compared by 64-bit hashes built by doubling (1, 2, 4, 8 words).
    Only texts with a repeated window sort them, to find the covered positions.
    """
    text = F.col("_t")
    # words that end in a mark, closing quotes left out: every mark as ".", then places of ". "
    ended = F.concat(F.translate(text, WHITE + MARKS + CLOSERS, " " * len(WHITE) + "." * len(MARKS)), F.lit(" "))
    d = docs.select("doc_id", whole().alias("_t"))
    d = d.select(
        "doc_id", "_t", words(text).alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE + " ", "")) > 0).alias("_l"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long").alias("n_capitals"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclaims"),
        F.length(F.translate(text, WHITE + " ", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, OTHERS, ""))).cast("long").alias("n_others"),
        ((F.length(ended) - F.length(F.replace(ended, F.lit(". "), F.lit("")))) / 2).cast("long").alias("n_marks"),
    )
    n = F.size("_w")
    d = d.withColumns({
        "n_words": n.cast("long"), "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.transform("_w", lambda x: F.xxhash64(x)),
    }).drop("_t", "_w", "_l")
    n = F.size("_h")
    d = d.withColumn("_h2", _pairs(F.col("_h"), F.col("_h"), n - 1, 1))
    d = d.withColumn("_h4", _pairs(F.col("_h2"), F.col("_h2"), n - 3, 2))
    d = d.withColumn("_h8", _pairs(F.col("_h4"), F.col("_h4"), n - 7, 4)).drop("_h", "_h2", "_h4")
    again = F.size(F.array_distinct("_h8")) < F.size("_h8")
    d = d.withColumn("_s", F.when(again, F.array_sort(F.transform("_h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    k = F.size("_s") - 1
    same = F.zip_with(F.slice("_s", 1, k), F.slice("_s", 2, k), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))
    k = F.size("_p") - 1
    steps = F.zip_with(F.slice("_p", 1, k), F.slice("_p", 2, k), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("_p").isNull(), 0).otherwise(covered).cast("long"))
    return d.drop("_h8", "_s", "_p")


def votes() -> dict[str, Column]:
    """Each rule's vote: -1, 0 or 1."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    c = F.col
    per_char = lambda name: c(name) / F.greatest(c("word_chars"), F.lit(1))
    mean = c("word_chars") / F.greatest(c("n_words"), F.lit(1))
    repeated = c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1))
    marks = c("n_marks") / F.greatest(c("n_words"), F.lit(1))
    dup = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    return {
        "length": vote(c("n_words") < 20, c("n_words") >= 50),
        "symbols": vote(per_char("n_symbols") > 0.05, per_char("n_symbols") < 0.01),
        "lines": vote((dup > 0.3) & (c("n_dup_lines") >= 4), (dup == 0) & (c("n_lines") >= 2)),
        "repeats": vote(repeated > 0.3, (repeated < 0.1) & (c("n_words") >= 20)),
        "word_length": vote((mean < 2) | (mean > 16), (mean >= 3) & (mean <= 10)),
        "capitals": vote(per_char("n_capitals") > 0.3, per_char("n_capitals") < 0.1),
        "exclaims": vote(per_char("n_exclaims") > 0.05, per_char("n_exclaims") < 0.01),
        "letters": vote(per_char("n_others") > 0.12, per_char("n_others") < 0.08),
        "marks": vote((marks < 0.05) & (c("n_words") >= 20), (marks >= 0.1) & (c("n_words") >= 20)),
    }


def _posterior(model: dict) -> Column:
    """Probability of "good" for the votes in columns v_<rule>."""
    score = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r in RULES:
        ratio = F.lit(0.0)
        for v in (-1, 0, 1):
            ratio = F.when(F.col(f"v_{r}") == v, math.log(model["good"][r][v] / model["bad"][r][v])).otherwise(ratio)
        score = score + ratio
    return 1 / (1 + F.exp(-score))


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], steps: int = 500) -> dict:
    """Expectation-maximisation over vote patterns: (votes in the order of RULES, number of rows), at most 3 ** len(RULES) of them.

    model[class][rule][vote]: how often the rule votes so on texts of the class.
    ``START`` gives the classes their meaning.  From there the rows decide for both classes; a Dirichlet prior of
    ``START``, weighing ``BELIEF`` times the rows, only keeps rates off 0.  A rule may not come out upside down:
    where it would object more often to good texts than to bad ones, or approve more often of bad ones, both classes
    get its rates over all rows, so it no longer counts.
    """
    model = {"prior": PRIOR} | {k: {r: dict(START[k]) for r in RULES} for k in START}
    total = sum(n for _, n in patterns)
    held = BELIEF * total + 1
    for _ in range(steps if total else 0):
        weight = {k: {r: dict.fromkeys((-1, 0, 1), 0.0) for r in RULES} for k in START}
        size = dict.fromkeys(START, 0.0)
        for votes_, n in patterns:
            odds = math.log(model["prior"] / (1 - model["prior"])) + sum(math.log(model["good"][r][v] / model["bad"][r][v]) for r, v in zip(RULES, votes_, strict=True))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            for k, share in (("good", p), ("bad", 1 - p)):
                size[k] += n * share
                for r, v in zip(RULES, votes_, strict=True):
                    weight[k][r][v] += n * share
        new = {"prior": min(0.99, max(0.01, size["good"] / total))}
        for k in START:
            new[k] = {r: {v: (weight[k][r][v] + held * START[k][v]) / (size[k] + held) for v in (-1, 0, 1)} for r in RULES}
        for r in RULES:
            if new["good"][r][-1] > new["bad"][r][-1] or new["good"][r][1] < new["bad"][r][1]:
                both = {v: (weight["good"][r][v] + weight["bad"][r][v] + 1) / (total + 3) for v in (-1, 0, 1)}
                new["good"][r], new["bad"][r] = both, dict(both)
        moved = max(abs(new[k][r][v] - model[k][r][v]) for k in START for r in RULES for v in (-1, 0, 1))
        model = new
        if moved < 1e-5:
            break
    return model


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, counts, votes, posterior, base_failed, kept."""
    spark = docs.sparkSession
    rated = written(text_features(docs).withColumns({f"v_{k}": v for k, v in votes().items()}), f"{shared_dir(spark)}/rules")
    patterns = rated.groupBy(*(f"v_{r}" for r in RULES)).agg(F.count("*").alias("n")).collect()
    model = fit_rules(sorted((tuple(r[:-1]), r["n"]) for r in patterns))
    return (
        rated.withColumn("posterior", _posterior(model))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )
