r"""Scoring texts by an n-gram language model in Elias-Fano tries.

Tokens are the words [^\x20\x09-\x0D]+, A-Z in lower case, and an end, which is also the context of a text's first token.
The model interpolates: p(w | u) = (c(uw) + MU * p1(w)) / (c(u) + MU), with p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
so it sums to one over the known words and one unknown.  c(uw) / (c(u) + MU) is what the trie stores, quantised
to 255 values a shard; the rest follows from counts of words.

1. Texts become blocks of about a million tokens: words by number, and their distinct hashes.  Blocks lie in a
   bucketed table, so that answers come to blocks and blocks never move.
2. Each block sends its distinct words with their training counts to shards by ranges of hashes.  A shard adds up, builds the
   first level (Elias-Fano over the hashes, counts) and answers every block with counts.
3. Each block sends its distinct pairs of known words to shards by context.  A shard adds up, builds the second level (contexts,
   monotone pointers, successors relative to their context, quantised probabilities), and answers with codes by
   successor search within the context.  A context seen more than SPLIT times is split over several shards.
4. Blocks put the answers together and sum by document.

Only counts of rows, tokens and words come to the driver.  A shard holds about a million pairs of all
blocks, whatever a word's share.  Levels are kept with ``model_path`` and answer for other documents later.  Every step
is a table in the shared folder.  Words are told apart by 64-bit hashes, successors in a context by 40 bits: two words of a
vocabulary of 10 million coincide with probability 3e-6, an unseen successor of a million looks seen with 1e-6.

Defined results: a null or empty text is one end; a null id is an id; a null ``train`` is false; repeated rows are
rows of their own and count as often; very long texts are a block of their own, held by one task; without training tokens every token has
p = 1 (V = N = 0 leave one unknown); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, discard, shared_dir, whole, written
from .elias_fano import FINGER, Successors, U, Words, mapped
from .near_dedup import _mix, word_hashes

#: The weight of the words' own probabilities, in observations of a context.
MU = 200.0
#: Bytes of text of a block, of a shard of words and of one of pairs; occurrences of a context beyond which its successors are split.
BLOCK_BYTES, WORD_BYTES, PAIR_BYTES, SPLIT = 6 << 20, 32 << 20, 6 << 20, 1 << 20
END = np.zeros(1, U)

BLOCKS = "block long, ids array<{kind}>, train binary, lengths binary, tokens binary, words binary, asks array<struct<shard: int, hashes: binary, counts: binary>>"
LEVEL = "block long, level int, shard int, answer binary, n long, distinct long"


def pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed; zero bytes of small numbers cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _block_rows(batches: Iterator[pa.RecordBatch], shards: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size, number, part = 0, 0, 0

    def row() -> pa.RecordBatch:
        ids, train, hashes = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]]
        lengths = np.array([len(x) + 1 for x in hashes], np.int64)
        flat = np.concatenate([x for h in hashes for x in (h, END)])
        words, tokens = np.unique(flat, return_inverse=True)
        counts = np.bincount(tokens, np.repeat(train, lengths), len(words)).astype(np.uint32)
        edges = np.searchsorted(word_shard(words, shards), np.arange(shards + 1))
        asks = [{"shard": s, "hashes": pack(gaps(words[a:b])), "counts": pack(counts[a:b])} for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(schema.field("ids").type)
        cells = [pack(train.astype(np.uint8)), pack(lengths.astype(np.uint32)), pack(tokens.astype(np.uint32)), pack(gaps(words))]
        arrays = [pa.array([part << 32 | number], pa.int64()), one, *(pa.array([c], pa.binary()) for c in cells), pa.array([asks], schema.field("asks").type)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        part = b["part"][0].as_py()
        texts, train = b["text"].to_pylist(), np.array(b["train"].to_pylist(), bool)
        at = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK_BYTES or i == len(texts) - 1:
                held.append((b["doc_id"].slice(at, i + 1 - at), train[at : i + 1], [word_hashes(x) for x in texts[at : i + 1]]))
                at = i + 1
            if size >= BLOCK_BYTES:
                yield row()
                held, size, number = [], 0, number + 1
    if held:
        yield row()


def _words_level(t: pa.Table, schema: pa.Schema) -> pa.Table:
    """One shard of words: adds up (or takes the model's level), answers blocks with counts."""
    shard, blocks = t["shard"][0].as_py(), t["block"].to_pylist()
    model = [i for i, b in enumerate(blocks) if b < 0]
    asked = [i for i, b in enumerate(blocks) if b >= 0]
    hashes = [np.cumsum(unpack(t["hashes"][i].as_py(), U), dtype=U) for i in asked]
    known, inverse = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, U), return_inverse=True)
    if model:
        data = t["hashes"][model[0]].as_py()
    else:
        counts = np.bincount(inverse, np.concatenate([unpack(t["counts"][i].as_py(), np.uint32) for i in asked]), len(known)).astype(np.int64)
        data = Words.build(known[counts > 0], counts[counts > 0])
    level = Words(mapped(data))
    found, at, rows = level.find(known)[inverse], 0, []
    for i, h in zip(asked, hashes, strict=True):
        rows.append((blocks[i], 1, shard, pack(found[at : at + len(h)].astype(U)), 0, 0))
        at += len(h)
    rows.append((-1, 1, shard, data, int(level.counts.sum(dtype=np.int64)), len(level.counts)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pairs_of(block: pa.Table, answers: pa.Table, shards: int) -> dict:
    """A block's tokens with counts of its words, its distinct pairs of known words, and how these are dealt to shards."""
    words = np.cumsum(unpack(block["words"][0].as_py(), U), dtype=U)
    tokens = unpack(block["tokens"][0].as_py(), np.uint32).astype(np.int64)
    lengths = unpack(block["lengths"][0].as_py(), np.uint32).astype(np.int64)
    train = np.repeat(unpack(block["train"][0].as_py(), np.uint8), lengths)
    got = sorted((s, a) for level, s, a in zip(answers["level"].to_pylist(), answers["shard"].to_pylist(), answers["answer"].to_pylist(), strict=True) if level == 1)
    counts = np.concatenate([unpack(a, U) for _, a in got]).astype(np.int64)
    # every text ends with an end, the first word of the next follows it
    before = np.concatenate([[np.searchsorted(words, END[0])], tokens[:-1]])
    pairs, inverse = np.unique(before * len(words) + tokens, return_inverse=True)
    seen = np.bincount(inverse, train, len(pairs)).astype(np.int64)
    u, w = np.divmod(pairs, len(words))
    asked = np.flatnonzero((counts[u] > 0) & (counts[w] > 0))
    u, w = u[asked], w[asked]
    finger = words[w] >> U(64 - FINGER)
    salt = finger % (U(1) + (counts[u] // SPLIT).astype(U))
    shard = (_mix(words[u] + salt * U(0x9E3779B97F4A7C15)) % U(shards)).astype(np.uint16 if shards <= 65_536 else np.int64)
    order = np.argsort(shard, kind="stable")
    return {"words": words, "tokens": tokens, "lengths": lengths, "counts": counts, "before": before, "inverse": inverse, "n": len(pairs), "asked": asked[order],
            "u": u[order], "finger": finger[order], "seen": seen[asked][order], "edges": np.searchsorted(shard[order], np.arange(shards + 1))}


def _pair_rows(block: pa.Table, answers: pa.Table, shards: int, schema: pa.Schema) -> pa.Table:
    p, rows = pairs_of(block, answers, shards), []
    for s, (a, b) in enumerate(zip(p["edges"], p["edges"][1:], strict=False)):
        if b > a:
            starts = np.flatnonzero(np.diff(p["u"][a:b], prepend=-1))
            own = p["u"][a:b][starts]
            fans = np.diff(starts, append=b - a)
            # within a context numbers rise, so their gaps are small where it has many
            fingers = np.diff(p["finger"][a:b], prepend=U(0))
            fingers[starts] = p["finger"][a:b][starts]
            rows.append((s, block["block"][0].as_py(), pack(gaps(p["words"][own])), pack(p["counts"][own].astype(U)), pack(fans.astype(np.uint32)), pack(fingers), pack(p["seen"][a:b].astype(np.uint32))))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _running(fingers: np.ndarray, fans: np.ndarray) -> np.ndarray:
    """Sums of gaps within each context."""
    total = np.cumsum(fingers, dtype=U)
    starts = np.cumsum(fans) - fans
    return total - np.repeat(total[starts] - fingers[starts], fans)


def _pairs_level(t: pa.Table, mu: float, schema: pa.Schema) -> pa.Table:
    """One shard of pairs: adds up and builds the level (or takes the model's), answers blocks with codes."""
    shard, blocks = t["shard"][0].as_py(), t["block"].to_pylist()
    model = [i for i, b in enumerate(blocks) if b < 0]
    asked = [i for i, b in enumerate(blocks) if b >= 0]
    col = lambda c, i, kind: unpack(t[c][i].as_py(), kind)
    contexts = [np.cumsum(col("contexts", i, U), dtype=U) for i in asked]
    totals, fans = [col("totals", i, U) for i in asked], [col("fans", i, np.uint32).astype(np.int64) for i in asked]
    fingers = [_running(col("fingers", i, U), f) for i, f in zip(asked, fans, strict=True)]
    flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    names, first, which = np.unique(flat(contexts, U), return_index=True, return_inverse=True)
    key = which.repeat(flat(fans, np.int64)).astype(U) << U(FINGER) | flat(fingers, U)
    key, inverse = np.unique(key, return_inverse=True)
    of, finger = (key >> U(FINGER)).astype(np.int64), key & U((1 << FINGER) - 1)
    if model:
        data = t["contexts"][model[0]].as_py()
    else:
        counts = np.bincount(inverse, flat([col("seen", i, np.uint32) for i in asked], np.uint32), len(key)).astype(np.int64)
        kept = counts > 0
        fan = np.bincount(of[kept], minlength=len(names))
        total = flat(totals, U)[first].astype(float)
        p = np.log10(counts[kept] / (total[of[kept]] + mu))
        data = Successors.build(names[fan > 0], fan[fan > 0], finger[kept], p)
    level = Successors(mapped(data))
    codes = level.find(names, np.bincount(of, minlength=len(names)), finger)[inverse]
    at, rows, centres = 0, [], level.centres.tobytes()
    for i, f in zip(asked, fingers, strict=True):
        rows.append((blocks[i], 2, shard, centres + pack(codes[at : at + len(f)]), 0, 0))
        at += len(f)
    rows.append((-1, 2, shard, data, 0, len(level.codes)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _scored(block: pa.Table, answers: pa.Table, shards: int, n: int, distinct: int, mu: float, schema: pa.Schema) -> pa.Table:
    p = pairs_of(block, answers, shards)
    got = sorted((s, a) for level, s, a in zip(answers["level"].to_pylist(), answers["shard"].to_pylist(), answers["answer"].to_pylist(), strict=True) if level == 2)
    seen = np.zeros(p["n"])
    for s, a in got:
        centres, codes = np.frombuffer(a[:1024], np.float32).astype(float), unpack(a[1024:], np.uint8)
        values = np.power(10.0, centres)
        values[0] = 0.0
        seen[p["asked"][p["edges"][s] : p["edges"][s + 1]]] = values[codes]
    single = (p["counts"] + 0.5) / (n + 0.5 * (distinct + 1))
    own, context = single[p["tokens"]], p["counts"][p["before"]]
    score = np.log10(seen[p["inverse"]] + mu / (context + mu) * own)
    starts = np.cumsum(p["lengths"]) - p["lengths"]
    add = lambda x: np.add.reduceat(x, starts)
    known = (p["counts"] > 0)[p["tokens"]].astype(np.int64)
    columns = [block["ids"].combine_chunks().flatten(), pa.array(unpack(block["train"][0].as_py(), np.uint8).astype(bool)), pa.array(p["lengths"]), pa.array(add(known)),
               pa.array(np.full(len(starts), n)), pa.array(add(np.log10(own))), pa.array(add(score))]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def score_texts(docs: DataFrame, train: str = "train", mu: float = MU, model_path: str | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score; docs: doc_id, text and a boolean column ``train``.

    ``model_path``: levels that a former call left there are used, and nothing is learned; where there are none, they are left there.
    """
    spark = docs.sparkSession
    folder, name = shared_dir(spark), f"sqlloom_lm_{uuid.uuid4().hex}"
    model = None
    if model_path and spark._jvm.org.apache.hadoop.fs.Path(model_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(model_path)):
        model = spark.read.schema(LEVEL + ", shards int").parquet(model_path)
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length(whole()))).first()[0] or 0
    shards = {1: 1 + size // WORD_BYTES, 2: 1 + size // PAIR_BYTES}
    if model:
        shards |= {r["level"]: r["shards"] for r in model.groupBy("level").agg(F.max("shards").alias("shards")).collect()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks_ddl = BLOCKS.format(kind=kind)
    blocks_schema, level_schema = _schema(spark, blocks_ddl), _schema(spark, LEVEL)
    words, pairs = shards[1], shards[2]
    rows = docs.select("doc_id", F.coalesce(F.col(train), F.lit(False)).alias("train"), whole().alias("text"), F.spark_partition_id().alias("part"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.mapInArrow(lambda batches: _block_rows(batches, words, blocks_schema), blocks_ddl)
    made.write.option("path", f"{folder}/blocks").bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)

    def old(level: int, columns: list[str], first: str) -> DataFrame:
        """The model's rows in the form of questions: a block below 0, the level's bytes in the first column."""
        m = model.filter(f"level = {level} AND block < 0")
        return m.select("shard", "block", *(F.col("answer").alias(c) if c == first else F.lit(None).cast("binary").alias(c) for c in columns))

    # a row is a block here, or what a block asks
    with arrow_rows(spark, 4):
        asks = blocks.select("block", F.explode("asks").alias("a")).select("a.shard", "block", "a.hashes", "a.counts")
        if model:
            asks = asks.unionByName(old(1, ["hashes", "counts"], "hashes"))
        level1 = written(asks.groupBy("shard").applyInArrow(lambda t: _words_level(t, level_schema), LEVEL), f"{folder}/level1")
        facts = level1.filter("block < 0").agg(F.sum("n").alias("n"), F.sum("distinct").alias("v")).first()
        n, distinct = facts["n"] or 0, facts["v"] or 0
        home, counts = blocks.drop("asks").groupBy("block"), level1.filter("block >= 0")
        pairs_ddl = "shard int, block long, contexts binary, totals binary, fans binary, fingers binary, seen binary"
        pairs_schema = _schema(spark, pairs_ddl)
        asked = home.cogroup(counts.groupBy("block")).applyInArrow(lambda b, a: _pair_rows(b, a, pairs, pairs_schema), pairs_ddl)
        if model:
            asked = asked.unionByName(old(2, pairs_ddl.replace(" int", "").replace(" long", "").replace(" binary", "").split(", ")[2:], "contexts"))
        level2 = written(asked.groupBy("shard").applyInArrow(lambda t: _pairs_level(t, mu, level_schema), LEVEL), f"{folder}/level2")
        out_ddl = f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        out_schema = _schema(spark, out_ddl)
        answers = counts.unionByName(level2.filter("block >= 0"))
        scored = home.cogroup(answers.groupBy("block")).applyInArrow(lambda b, a: _scored(b, a, pairs, n, distinct, mu, out_schema), out_ddl)
        out = written(scored, f"{folder}/scored")
    if model_path and not model:
        shard_of = F.when(F.col("level") == 1, words).otherwise(pairs)
        level1.unionByName(level2).filter("block < 0").withColumn("shards", shard_of.cast("int")).write.parquet(model_path)
    spark.sql(f"DROP TABLE {name}")
    discard(spark, *(f"{folder}/{x}" for x in ("blocks", "level1", "level2")))
    return out
