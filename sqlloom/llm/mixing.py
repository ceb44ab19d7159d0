"""Mixing sources to target weights by pivotal dependent rounding.

Sources, by code point and null last, weigh 5, 2, 1, repeating.  Their
targets share all words by weight, stop at ``most`` times the source's size,
and pass the excess on by weight.  A document is copied floor(target / size)
times for sure; the fraction is rounded by the pivotal method.  Two documents
of fractional copy probabilities duel: mass, counted in words, moves from one
to the other at random, so that neither expectation changes, until one of
them has a whole number of copies; the other goes on.  As words are what moves,
a duel leaves the words of both together as they were.

Distribution: documents are dealt by a hash of id, text and size into chunks
of about ``chunk_rows``, each rounded in its own group; a chunk leaves at most
one fractional document.  Those residuals combine in a tree of fan-in
``fan_in``, level by level, until a source has one, which is rounded by a draw.
No group holds more than a chunk or a level's fan-in, whatever share of the rows
a source has; rows equal in id, text and source are counted, not listed,
until they reach their chunks in portions.

What that draw leaves over or short is settled among a few documents of each source, the first sixteen by hash of each power of two of
sizes: one to three of them change between the two whole numbers around their expectation
where that brings the source nearer to its target.  So every document keeps one of these two numbers of copies, whatever the source's size.

Defined results: null or empty texts have size 0 and take 0 words; repeated
rows are rows of their own, and rerunning gives their copies again as a group;
a source without words has target 0; a null source is a source; null ids are an
id like any other; the size of a very long text is one number; an empty table
gives an empty table; other columns are ignored.  The draws are hashes, so
reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, discard, shared_dir, whole, written

WEIGHTS = (5, 2, 1)
#: Documents of one source and size class that may settle what is left; equal rows that travel as one portion.
LADDER, PORTION = 16, 512


def source_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Water-filling of the sum of sizes by weight, at most ``most`` times each size.  One row a source: bounded by their number."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, free, out = float(sum(n for _, n in order)), dict(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s, n in free.items() if left * weight[s] / total > most * n]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            out[s] = float(most * free.pop(s))
        left = max(0.0, float(sum(n for _, n in order)) - sum(out.values()))
    return out


def duels(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Rounds copy probabilities in order; returns 0/1 results, and the place (or -1) and probability of the one left fractional."""
    out, held, mass = np.zeros(len(p), np.int64), -1, 0.0
    for i, (x, w, u) in enumerate(zip(p.tolist(), size.tolist(), draws.tolist(), strict=True)):
        if x <= 0 or held < 0:
            held, mass = (i, x) if x > 0 else (held, mass)
            continue
        v = float(size[held])
        # words that can move to the held one, and from it
        up, down = min((1 - mass) * v, x * w), min(mass * v, (1 - x) * w)
        moved = up if u * (up + down) < down else -down
        mass, x = mass + moved / v, x - moved / w
        for place, q in ((held, mass), (i, x)):
            if q > 1 - 1e-9:
                out[place] = 1
        if 1e-9 < x < 1 - 1e-9:
            held, mass = i, x
        elif not 1e-9 < mass < 1 - 1e-9:
            held, mass = -1, 0.0
    return out, held, mass


def _round(table: pa.Table) -> pa.Table:
    """One group, portions spread out to rows, longest first; ``add`` counts the copies so far, ``p`` is what stays fractional."""
    n = table["n"].to_numpy()
    row, place = np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, np.int64)
    base = table["_u"].to_numpy().astype(np.uint64)[row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    base = (base ^ (base >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    base = (base ^ (base >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    draw = ((base ^ (base >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
    size = table["size"].to_numpy()[row]
    order = np.lexsort((draw, table["_u"].to_numpy()[row], -size))
    row, size, draw = row[order], size[order], draw[order]
    add, held, mass = duels(table["p"].to_numpy()[row], size, draw)
    rest = np.zeros(len(row))
    if held >= 0:
        rest[held] = mass
    t = table.take(pa.array(row))
    put = lambda t, name, x: t.set_column(t.schema.get_field_index(name), name, pa.array(x))
    # the draw's own bits become the row's number from here on
    return put(put(put(put(t, "p", rest), "add", add + t["add"].to_numpy()), "n", np.ones(len(row), np.int64)), "_u", (draw * float(1 << 53)).astype(np.int64))


def _nearest_change(delta: np.ndarray, missing: float, enough: float) -> list[int]:
    """The one, two or three documents whose changes together come nearest to ``missing``; the fewest that come within ``enough``."""
    one = np.abs(missing - delta)
    found = [(float(one.min()), [int(one.argmin())])]
    if found[0][0] > enough and len(delta) > 1:
        j, k = np.triu_indices(len(delta), 1)
        sums = delta[j] + delta[k]
        two = np.abs(missing - sums)
        at = int(two.argmin())
        found.append((float(two[at]), [int(j[at]), int(k[at])]))
        if found[-1][0] > enough and len(delta) > 2:
            # for each third document the pairs whose sum is nearest to what it leaves; pairs that hold it do not count
            order = np.argsort(sums, kind="stable")
            place = np.searchsorted(sums[order], missing - delta)
            near = order[np.clip(place[:, None] + np.arange(-4, 4), 0, len(sums) - 1)]
            third = np.arange(len(delta))[:, None]
            three = np.where((j[near] == third) | (k[near] == third), np.inf, np.abs(missing - delta[:, None] - sums[near]))
            i, c = np.unravel_index(three.argmin(), three.shape)
            found.append((float(three[i, c]), [int(i), int(j[near[i, c]]), int(k[near[i, c]])]))
    return next((x for best, x in found if best <= enough), min(found)[1])


def settle(sizes: list[int], up: list[int], missing: float) -> list[int]:
    """Which documents are rounded up (1) or down (0), such that the words added come near to ``missing``.

    As long as it helps, the documents change (three at most) that bring the words nearest, as few as leave
    no more than half the smallest document.
    """
    out, size = np.array(up, np.int64), np.array(sizes, float)
    while len(out) and abs(missing) > size.min() / 2:
        delta = np.where(out == 0, size, -size)
        flips = _nearest_change(delta, missing, size.min() / 2)
        after = missing - float(delta[flips].sum())
        if abs(after) >= abs(missing) - 1e-9:
            break
        missing = after
        out[flips] = 1 - out[flips]
    return out.tolist()


def _settled(table: pa.Table) -> pa.Table:
    """One source's ladder, smallest documents first: the copies that come near to its target."""
    t = table.sort_by([("size", "ascending"), ("_key", "ascending"), ("_u", "ascending")])
    whole = np.array(t["whole"].to_pylist(), np.int64)
    new = settle(t["size"].to_pylist(), (np.array(t["add"].to_pylist(), np.int64) - whole).tolist(), t["missing"][0].as_py())
    return t.select(["_key", "_u"]).append_column("settled", pa.array(whole + np.array(new, np.int64), pa.int64()))


def _draw(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: int = 17, chunk_rows: int = 4_000, fan_in: int = 64) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies, taken; one row for each row of docs."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    size = F.regexp_count(whole(), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", F.xxhash64(whole()).alias("text_hash"), size.alias("size"))
    sized = written(rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("m")), f"{folder}/sizes")
    per_source = [(r["source"], r["n"], r["rows"]) for r in sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("n"), F.sum("m").alias("rows")).collect()]
    target = source_targets([(s, n) for s, n, _ in per_source], weights, most)
    facts = spark.createDataFrame(
        [(s, n, target[s], math.floor(target[s] / n) if n else 0, target[s] / n - math.floor(target[s] / n) if n else 0.0, max(1, math.ceil(rows / chunk_rows))) for s, n, rows in per_source],
        "source string, source_size long, target double, whole long, part double, chunks long",
    )
    d = sized.withColumnRenamed("source", "_src").join(facts, F.col("_src").eqNullSafe(F.col("source"))).drop("_src")
    # equal rows in portions, each with its own chunk and draws
    d = d.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / PORTION))))
    key = F.xxhash64(F.lit(seed), "doc_id", "text_hash", "size", "source", "_part")
    d = d.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", F.least(F.lit(PORTION), F.col("m") - F.col("_part") * PORTION).cast("long").alias("n"),
        "whole", "part", F.col("whole").alias("add"), F.when(F.col("size") > 0, F.col("part")).otherwise(0.0).alias("p"), "chunks",
        F.pmod(F.xxhash64(F.lit("chunk"), key), F.col("chunks")).alias("_c"), F.xxhash64(F.lit("draw"), key).alias("_u"),
    )
    level, done = d, []
    most_chunks = max((math.ceil(rows / chunk_rows) for *_, rows in per_source), default=1)
    k = 0
    while True:
        out = written(level.groupBy("source", "_c").applyInArrow(_round, level.schema), f"{folder}/level{k}")
        if most_chunks <= 1:
            done.append(out.withColumn("add", F.col("add") + F.when(_draw(F.lit(seed), F.lit("last"), "doc_id", "text_hash") < F.col("p"), 1).otherwise(0)))
            break
        done.append(out.filter("p = 0"))
        level = out.filter("p > 0").withColumn("_c", F.floor(F.col("_c") / fan_in))
        most_chunks, k = math.ceil(most_chunks / fan_in), k + 1
    rounded = done[0]
    for x in done[1:]:
        rounded = rounded.unionByName(x)
    key = F.xxhash64("doc_id", "text_hash", "source", "size")
    rounded = written(rounded.select("doc_id", "source", "text_hash", "size", "source_size", "target", "whole", "part", "add", key.alias("_key"), "_u"), f"{folder}/rounded")
    discard(spark, f"{folder}/sizes", *(f"{folder}/level{i}" for i in range(k + 1)))
    # few documents of each source settle what is left
    # where expectations are whole numbers there is nothing to choose
    sized = rounded.filter("size > 0 and part > 0").withColumn("_bin", F.floor(F.log2("size")))
    # the first of each class by hash: tasks keep that many of their own before anything is shuffled
    first = F.row_number().over(W.partitionBy("source", "_bin").orderBy(F.xxhash64(F.lit(seed), F.lit("rung"), "_key", "_u"), "_key", "_u"))
    ladder = sized.withColumn("_rung", first).filter(F.col("_rung") <= LADDER)
    left = rounded.groupBy(F.col("source").alias("_src")).agg((F.first("target") - F.sum(F.col("add") * F.col("size"))).alias("missing"))
    ladder = ladder.join(left, F.col("source").eqNullSafe(F.col("_src"))).select("source", "_key", "_u", "size", "whole", "add", "missing")
    settled = ladder.groupBy("source").applyInArrow(_settled, "_key long, _u long, settled long")
    # rows equal in all of this are interchangeable: only one of them is a rung
    settled = settled.groupBy("_key", "_u").agg(F.first("settled").alias("settled"))
    out = rounded.join(settled, ["_key", "_u"], "left").withColumn("copies", F.coalesce("settled", "add"))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Rows equal in doc_id, source and text are one document: the copies of all of them are copies
    of that with the smallest other columns.
    """
    key = ["doc_id", "source", "text_hash"]
    taken = mix_sources(docs, **parameters).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    taken = written(taken.select(*(F.col(c).alias(f"_m_{c}") for c in key), F.col("copies").alias("_copies"), F.col("rows").alias("_rows")), f"{shared_dir(docs.sparkSession)}/taken")
    same = docs["doc_id"].eqNullSafe(F.col("_m_doc_id")) & docs["source"].eqNullSafe(F.col("_m_source")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_m_text_hash"))
    found = docs.join(taken, same)
    # of equal rows the first; their groups fold before they move
    others = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text", "source")), F.lit(0).alias("_")))
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), others))
    repeated = found.filter("_rows > 1").groupBy("_m_doc_id", "_m_source", "_m_text_hash").agg(first.alias("_r"), F.first("_copies").alias("_copies")).select("_r.*", "_copies")
    rows = found.filter("_rows = 1").select(*docs.columns, "_copies").unionByName(repeated)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
