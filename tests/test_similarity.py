"""The n-gram index against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from sqlloom import queries
from sqlloom.operators import fuzzy
from sqlloom.operators.similarity import _rarity, _names, candidate_pairs, similar_pairs, top_similar


def invented(seed, n):
    """Names with neighbours: edits, plurals, parts of each other, repeated letters, other scripts."""
    rng = random.Random(seed)
    out = ["s", "_", "ss", "", "a", "id", "aaaa", "aaaaaaaa", "straße", "日本語", "日本", None, "x" * 250, "x" * 240 + "y" * 9]
    stems = ["customer", "order_date", "line", "price", "Country", "shipment", "qty", "name", "supplier_key"]
    while len(out) < n:
        w = rng.choice(stems) + rng.choice(["", "s", "_id", "es", rng.choice(stems)])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice("abcdexyz_s") + w[i + rng.randrange(2) :]
        out.append(w)
    return out


def frame(spark, names, column, groups=None):
    return spark.createDataFrame([(w, None if groups is None else ["g", "h", None][i % groups]) for i, w in enumerate(names)], f"{column} string, db string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "cutoff"), [(3, 0.55)])
def test_top_as_all_pairs(spark, n, cutoff):
    w, o = frame(spark, invented(1, 90), "word"), frame(spark, invented(2, 110), "option")
    got = top_similar(w, o, n=n, cutoff=cutoff)
    want = fuzzy.closest(w.filter("word is not null"), o.filter("option is not null"), [], n=n, cutoff=cutoff)
    assert rows(got) == rows(want.select(*got.columns)) and got.count() > 30


def test_top_within_groups(spark):
    w, o = frame(spark, invented(3, 60), "word", 3), frame(spark, invented(4, 90), "option", 3)
    got = top_similar(w, o, on=["db"])
    want = fuzzy.closest(w.dropna(), o.dropna(), ["db"])
    assert rows(got) == rows(want.select(*got.columns)) and got.count() > 30
    assert top_similar(w.limit(0), o, on=["db"]).count() == top_similar(w, o.limit(0), on=["db"]).count() == 0


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.72, 0.85, 0.95, 1.0])
def test_no_pair_is_lost(spark, cutoff):
    a, b = invented(5, 120), invented(6, 120)
    got = similar_pairs(frame(spark, a, "word"), frame(spark, b, "option"), cutoff)
    want = {(x, y) for x in a for y in b if x and y and difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() >= cutoff}
    assert {(r["word"], r["option"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_grow_with_the_list(spark):
    """Random words and neighbours of 200 of them: four times the words give about four times the candidates at a high threshold, not sixteen."""
    rng, counts = random.Random(9), []
    for n in (1000, 4000):
        names = _names(spark.createDataFrame([("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(8, 16))),) for _ in range(n)], "word string"), [], "word")
        names = names.unionByName(names.limit(200).select("_w", F.concat("_x", F.lit("a"))).toDF("_w", "_x"))
        pairs = candidate_pairs(names, names, [], 0.9, 3, _rarity(names.select("_x"))).count()
        counts.append(pairs / n)
    assert 1 <= counts[1] < 1.2 * counts[0]


def test_queries(spark, sf_dir):
    got = queries.QUERIES["top_k_closest"](spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    want = fuzzy.closest(queries.part_words(spark, sf_dir), part.select(F.lower("p_type").alias("option")).distinct(), [])
    assert rows(got) == rows(want.select(*got.columns))
    words, options = queries.part_words(spark, sf_dir), queries.conversation_words(spark, sf_dir)
    got = queries.QUERIES["nearest_words"](spark, sf_dir)
    assert rows(got) == rows(fuzzy.closest(words, options, [], n=2, cutoff=0.6).select(*got.columns)) and got.count() > 5
