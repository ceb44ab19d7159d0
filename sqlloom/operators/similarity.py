"""The most similar names of a large list, by an inverted index of n-grams instead of all pairs.

Similarity is that of ``fuzzy.text_similarity``: the share of characters in matching blocks, with floors for names that differ
in "_" and a plural s, or of which one holds the other.  Two names of S characters together whose share
is t or more have M >= t S / 2 characters in blocks, and blocks are kept apart by characters outside of them, so there are at
most 1 + S - 2 M blocks.  Hence

* neither name is shorter than M;
* they share M - (q - 1) * blocks q-grams at least, repeated ones counted.

Of a set that must share k elements with another, j are among the first |set| - k + j elements, in any fixed order: only those
are indexed, the rarest first, one by one (characters) or in pairs (longer grams).  All bounds are exact: no pair is lost.
Below a threshold of about 0.7 the bounds turn few pairs away, as characters alone tell little.

A top-n search goes down in thresholds.  High ones need few and long grams; a name with n options at a threshold
is done, and only the others go on to the next.  What the floors lift is found by equality, and by grams of the shorter name.

Where one list is short (FEW names at most), each name of the other is held against all of it: that takes less than the grams of
a name do, and grows with the longer list.  The same descent then scores what shared characters and floors allow.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import discard, spread, written
from .fuzzy import match_ratio

#: Thresholds of the descent, and the length of grams from each on.
STEPS = ((0.9, 3), (0.8, 2), (0.68, 1))
#: Characters whose frequency is looked at; the longest gram by which containment is found.
LETTERS, HELD = 256, 5
#: Names of a list that the other is held against without an index.
FEW = 40


def _needed(length: Column, t: float, q: int) -> Column:
    """q-grams that a name of this length shares at least with any name that is as similar as t; the bound grows with the lengths."""
    both = length + F.ceil(length * (t / (2 - t)) - 1e-9)
    return F.ceil(both * (t / 2 * (2 * q - 1) - (q - 1)) - (q - 1) - 1e-9)


def _routes(t: float, q: int) -> list[tuple[int, int, int, int]]:
    """(q, shared, least, below): pairs whose shorter name has from ``least`` to below ``below`` characters meet by sets of ``shared`` q-grams."""
    out, below = [], 1 << 30
    for shared in (2, 1) if q > 1 else ():
        for n in range(q + 1, 1000):
            both = n + math.ceil(n * t / (2 - t) - 1e-9)
            if math.ceil(both * (t / 2 * (2 * q - 1) - (q - 1)) - (q - 1) - 1e-9) >= shared:
                out.append((q, shared, n, below))
                below = n
                break
    return [*out, (1, 1, 0, below)]


def _grams(text: Column, q: int) -> Column:
    """q-grams, the second time with its number, and so on."""
    plain = F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.transform(plain, lambda x, i: F.struct(x.alias("g"), F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda y: y == x)).alias("n")))


def _rarity(names: DataFrame) -> Column:
    """A map from the most frequent characters to the logarithm of their share; its size is bounded by LETTERS."""
    counts = names.select(F.explode(F.split("_x", "")).alias("c")).filter("c <> ''").groupBy("c").count().orderBy(F.col("count").desc(), "c").limit(LETTERS).collect()
    total = sum(r["count"] for r in counts) or 1
    # one literal: a map made of columns would be a large expression at every use
    return F.from_json(F.lit(json.dumps({r["c"]: math.log(r["count"] / total) for r in counts})), "map<string,double>")


def _first(text: Column, t: float, q: int, shared: int, rarity: Column) -> Column:
    """The rarest grams of a name, as many as must hold ``shared`` of those that it has in common with any name as similar as t."""
    rank = lambda g: sum((F.coalesce(F.try_element_at(rarity, F.substring(g, i + 1, 1)), F.lit(-20.0)) for i in range(q)), F.lit(0.0))
    ordered = F.array_sort(F.transform(_grams(text, q), lambda x: F.struct(rank(x["g"]).alias("r"), x["g"].alias("g"), x["n"].alias("n"))))
    many = F.least(F.size(ordered), F.greatest(F.size(ordered) - _needed(F.length(text), t, q) + shared, F.lit(0)).cast("int"))
    return F.transform(F.slice(ordered, F.lit(1), many), lambda x: F.concat_ws("#", x["g"], x["n"].cast("string")))


def _characters(names: DataFrame) -> DataFrame:
    """names with their characters, the second time one occurs with its number, and so on."""
    return names.withColumn("_all", F.transform(_grams(F.col("_x"), 1), lambda x: F.concat_ws("#", x["g"], x["n"].cast("string"))))


def _indexed(names: DataFrame, t: float, q: int, rarity: Column) -> DataFrame:
    """Names by route and key, with the grams that keys are made of."""
    names, out = _characters(names), None
    for i, (size, shared, least, below) in enumerate(_routes(t, q)):
        own = names.filter((F.length("_x") >= least) & (F.length("_x") < below * (2 - t) / t)).withColumn("_own", _first(F.col("_x"), t, size, shared, rarity))
        pairs = F.flatten(F.transform("_own", lambda x, k: F.transform(F.slice("_own", k + 2, F.size("_own")), lambda y: F.concat_ws("|", x, y))))
        own = own.withColumn("_route", F.lit(i)).withColumn("_key", F.explode(pairs if shared == 2 else F.col("_own")))
        out = out.unionByName(own) if out is not None else own
    return out


def _bare(x: str) -> Column:
    return F.regexp_replace(F.replace(F.col(x), F.lit("_"), F.lit("")), "s+$", "")


def _same(on: list[str], other: str = "_o") -> Column:
    fit = F.lit(True)
    for c in on:
        fit = fit & (F.col(c) == F.col(f"{other}{c}"))
    return fit


def candidate_pairs(words: DataFrame, options: DataFrame, on: list[str], t: float, q: int, rarity: Column) -> DataFrame:
    """on, _w, _x, _option, _y: pairs of names (lower case in _x and _y) whose lengths, indexed grams and characters allow a share of t, each once."""
    routes = _routes(t, q)
    named = {"_w": "_option", "_x": "_y", "_key": "_okey", "_route": "_oroute", "_own": "_oown", "_all": "_oall"} | {c: f"_o{c}" for c in on}
    right = _indexed(options, t, q, rarity).select(*(F.col(c).alias(named[c]) for c in (*on, "_w", "_x", "_key", "_route", "_own", "_all")))
    both, shorter = F.length("_x") + F.length("_y"), F.least(F.length("_x"), F.length("_y"))
    of = lambda place: F.array(*(F.lit(r[place]) for r in routes))[F.col("_route")]
    fits = (F.col("_key") == F.col("_okey")) & (F.col("_route") == F.col("_oroute")) & _same(on) & (2 * shorter >= t * both - 1e-9) & (shorter >= of(2)) & (shorter < of(3))
    # a pair counts under the first key that both have
    common = F.array_intersect("_own", "_oown")
    once = F.when(of(1) == 1, F.get(common, F.lit(0))).otherwise(F.array_join(F.slice(common, 1, 2), "|")) == F.col("_key")
    enough = F.size(F.array_intersect("_all", "_oall")) >= F.ceil(both * (t / 2) - 1e-9)
    return _indexed(words, t, q, rarity).join(right, fits & once & enough).select(*on, "_w", "_x", "_option", "_y")


def _floors(words: DataFrame, options: DataFrame, on: list[str], n: int) -> DataFrame:
    """on, _w, _option, _sim: pairs that differ in "_" and a plural s (0.97), or of which one holds the other (0.8).

    A name of which nothing is left (an s, say) is held by all: of these pairs the n last by name are enough.
    """
    a = words.withColumn("_bare", _bare("_x"))
    b = options.withColumn("_bare", _bare("_x")).select(*(F.col(c).alias(f"_o{c}") for c in on), F.col("_w").alias("_option"), F.col("_bare").alias("_obare"))
    # two empty names are alike; no gram tells of them
    alike = F.when((F.col("_w") == "") & (F.col("_option") == ""), 1.0).otherwise(0.97)
    out = a.join(b, (F.col("_bare") == F.col("_obare")) & _same(on)).select(*on, "_w", "_option", alike.alias("_sim"))

    def first(bare: str) -> Column:
        return F.substring(F.col(bare), F.lit(1), F.lit(HELD))

    def every(bare: str) -> Column:
        x = F.col(bare)
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(HELD)), lambda k: F.when(F.length(x) >= k, F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda i: F.substring(x, i, k))).otherwise(F.array().cast("array<string>")))))

    for holder, held, left, right in (("_obare", "_bare", first("_bare"), every("_obare")), ("_bare", "_obare", every("_bare"), first("_obare"))):
        x, y = (d.filter(F.col(c) != "") for d, c in ((a, "_bare"), (b, "_obare")))
        x = x.withColumn("_key", left) if held == "_bare" else x.withColumn("_key", F.explode(left))
        y = y.withColumn("_okey", right) if held == "_obare" else y.withColumn("_okey", F.explode(right))
        found = x.join(y, (F.col("_key") == F.col("_okey")) & _same(on) & F.contains(F.col(holder), F.col(held)))
        out = out.unionByName(found.select(*on, "_w", "_option", F.lit(0.8).alias("_sim")))

    def last(df: DataFrame, names: list[str], option: str) -> DataFrame:
        """The n last options of each group as an array."""
        if not names:
            return df.sparkSession.createDataFrame([([r[0] for r in df.select(option).distinct().orderBy(F.col(option).desc()).limit(n).collect()],)], "_last array<string>")
        placed = df.select(*names, option).distinct().withColumn("_rn", F.row_number().over(W.partitionBy(*names).orderBy(F.col(option).desc()))).filter(F.col("_rn") <= n)
        return placed.groupBy(*names).agg(F.collect_list(option).alias("_last"))

    for x, y in ((a.filter("_bare = ''"), b), (a, b.filter("_obare = ''"))):
        tops = last(y, [f"_o{c}" for c in on], "_option")
        if on:
            found = x.join(tops, _same(on))
        else:
            found = x.withColumn("_last", F.array(*(F.lit(o) for o in tops.first()["_last"])).cast("array<string>"))
        out = out.unionByName(found.select(*on, "_w", F.explode("_last").alias("_option"), F.lit(0.8).alias("_sim")))
    return out.groupBy(*on, "_w", "_option").agg(F.max("_sim").alias("_sim"))


def _short(names: DataFrame) -> bool:
    return names.limit(FEW + 1).count() <= FEW


def _held_against(words: DataFrame, options: DataFrame, on: list[str], cutoff: float, few_words: bool) -> DataFrame:
    """on, _w, _x, _option, _y, _most, _floor: pairs that reach the cutoff by a floor, or may by the characters that they share; one of the lists is short."""
    short, long = (words, options) if few_words else (options, words)
    short, long = (_characters(d).withColumn("_bare", _bare("_x")) for d in (short, spread(long)))
    left, right = (short, long) if few_words else (long, short)
    named = {"_w": "_option", "_x": "_y", "_all": "_oall", "_bare": "_obare"} | {c: f"_o{c}" for c in on}
    right = right.select(*(F.col(c).alias(n) for c, n in named.items()))
    left, right = (F.broadcast(left), right) if few_words else (left, F.broadcast(right))
    both, shorter = F.length("_x") + F.length("_y"), F.least(F.length("_x"), F.length("_y"))
    floor = (
        F.when((F.col("_w") == "") & (F.col("_option") == ""), 1.0).when(F.col("_bare") == F.col("_obare"), 0.97)
        .when(F.contains(F.col("_bare"), F.col("_obare")) | F.contains(F.col("_obare"), F.col("_bare")), 0.8).otherwise(0.0)
    )
    # as the ratio is worked out, so that it is never above
    most = F.when(both > 0, 2.0 * F.size(F.array_intersect("_all", "_oall")) / both).otherwise(1.0)
    allowed = (floor >= cutoff) | ((2.0 * shorter / both >= cutoff) & (most >= cutoff))
    return left.join(right, _same(on) & allowed).select(*on, "_w", "_x", "_option", "_y", most.alias("_most"), floor.alias("_floor"))


def similar_pairs(words: DataFrame, options: DataFrame, cutoff: float, on: tuple[str, ...] | list[str] = (), word: str = "word", option: str = "option") -> DataFrame:
    """on, word, option, ratio: all pairs whose match ratio is ``cutoff`` or more (0 < cutoff <= 1); null and empty names match nothing."""
    on = list(on)
    w, o = _names(words, on, word), _names(options, on, option)
    q = next((q for t, q in STEPS if cutoff >= t), 1)
    found = candidate_pairs(w, o, on, cutoff, q, _rarity(w.select("_x").unionByName(o.select("_x"))))
    found = found.withColumn("ratio", match_ratio(F.col("_x"), F.col("_y"))).filter(F.col("ratio") >= cutoff)
    return found.select(*on, F.col("_w").alias(word), F.col("_option").alias(option), "ratio")


def _names(df: DataFrame, on: list[str], name: str) -> DataFrame:
    some = F.col(name).isNotNull()
    for c in on:
        some = some & F.col(c).isNotNull()
    return df.filter(some).select(*on, F.col(name).alias("_w"), F.lower(name).alias("_x")).distinct()


def top_similar(words: DataFrame, options: DataFrame, on: tuple[str, ...] | list[str] = (), word: str = "word", option: str = "option", n: int = 3, cutoff: float = 0.55) -> DataFrame:
    """on, word, option, similarity, place: the top n options of each word by (similarity, name), both descending, of those that reach the cutoff.

    The rows of ``fuzzy.closest``, for lists of any length.  Null names have no options.
    """
    on, keys = list(on), [*on, "_w"]
    open_, o = written(_names(words, on, word), "open-words"), written(_names(options, on, option), "options")
    few_words = _short(open_)
    if few_words or _short(o):
        held = written(_held_against(open_, o, on, cutoff, few_words), "held-against")
    else:
        held, rarity = None, _rarity(open_.select("_x").unionByName(o.select("_x")))
        floors = written(_floors(open_, o, on, n), "floors")
    done, used = [], [o, floors if held is None else held]
    steps = [*((t, q) for t, q in STEPS if t > cutoff), (cutoff, next((q for t, q in STEPS if cutoff >= t), 1))]
    for k, (t, q) in enumerate(steps):
        if held is None:
            pairs = candidate_pairs(open_, o, on, t, q, rarity).withColumn("_sim", match_ratio(F.col("_x"), F.col("_y"))).select(*keys, "_option", "_sim")
            lifted = floors.join(open_.select(*keys), keys, "left_semi") if k else floors
            found = pairs.unionByName(lifted).filter(F.col("_sim") >= t).groupBy(*keys, "_option").agg(F.max("_sim").alias("_sim"))
        else:
            own = (held.join(open_.select(*keys), keys, "left_semi") if k else held).filter(F.greatest("_most", "_floor") >= t)
            # null where the floor decides: nothing is worked out then
            ratio = match_ratio(F.when((F.col("_most") >= t) & (F.col("_most") > F.col("_floor")), F.col("_x")), F.col("_y"))
            found = own.withColumn("_sim", F.greatest(ratio, "_floor")).filter(F.col("_sim") >= t).select(*keys, "_option", "_sim")
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_sim").desc(), F.col("_option").desc()))
        top = written(found.withColumn("place", place).filter(F.col("place") <= n), "similar")
        used.append(open_)
        if k == len(steps) - 1:
            done.append(top)
            break
        full = top.filter(F.col("place") == n).select(*keys)
        done.append(top.join(full, keys, "left_semi"))
        open_ = written(open_.join(full, keys, "left_anti"), "open-words")
        if not open_.head(1):
            used.append(open_)
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    for d in used:
        discard(d)
    return out.select(*on, F.col("_w").alias(word), F.col("_option").alias(option), F.col("_sim").alias("similarity"), "place")
