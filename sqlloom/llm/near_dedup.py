"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct 5-word shingles (with fewer words, the
whole sequence).  Documents are linked where 100 * intersection >= 85 * union.

1. One pass over the texts gives each document its set's digest, size and a
   SetSketch: M registers, each an exponentially spaced, truncated minimum of
   exponential variates of the elements.  Registers merge by maximum.
2. Equal sets collapse to one class, with a number of its own.  ROWS registers
   at a time make the key of a band; classes that share a key are candidates.
3. In each bucket the class that meets most others (its hub) is paired with all
   members, in portions of about FAN.  Pairs whose joint likelihood, from registers
   and known sizes, allows the threshold are verified on full sets.  Links give
   components.
4. Only buckets with several components are looked at again: their pairs of
   different components are judged in blocks, by likelihood and by what both
   share with the hub, then verified likewise.  A pair is emitted in the first
   band that both share, and never where one component already holds both.
5. Components of all links, by minimum labels with shortcuts; rows of one doc_id
   with several texts link the classes of these texts too.

At similarity 0.85 a pair escapes all 20 bands with probability 1e-5, and the
likelihood bound with 1e-5.  Nothing is capped: a bucket of any size is cut
into blocks, and no group is collected.  Joins with a hub go by (hub, portion),
never by the hub alone.

Defined results: null texts and texts without a word have an empty set
(n_shingles 0), are linked with nothing and are their own component; rows
with one doc_id are one document: links of any of their texts are its links, and
each row has its own n_shingles; a null doc_id gives a null component and is kept;
a very long text is one row in its task, hashed in pieces; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, shared_dir, whole, written

SHINGLE, PERCENT = 5, 85
M, ROWS, BANDS, BASE, RATE = 512, 5, 20, 1.02, 20.0
#: The bound of the likelihood ratio, 2 * (log L(best) - log L(threshold)): 4.5 standard deviations.
LIKELY = 20.25
#: Members of a block of a bucket, and members that are compared with one copy of a hub's text.
BLOCK, FAN = 512, 256
_rng = np.random.Generator(np.random.PCG64(20_240_501))
BYTES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
POWER = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
INVERSE = pow(POWER, -1, 1 << 64)
PLACES = _rng.integers(0, 1 << 63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)
ODD = (_rng.integers(0, 1 << 31, M, np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((POWER, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+, A-Z in lower case: differences of one running sum over the bytes."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * up[: len(raw)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the document's set."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    width = min(n, SHINGLE)
    h = np.full(n - width + 1, np.uint64(width) * PLACES[SHINGLE])
    for i in range(width):
        h += w[i : n - width + 1 + i] * PLACES[i]
    return np.unique(_mix(h))


def sketch(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    x = (elements >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = np.full(M, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * ODD).min(axis=0), out=least)
    u = (least.astype(float) + 0.5) / 2**32
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / math.log(BASE))
    return np.clip(k, 0, 2047).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """The exact register values of each band, with its number above them (11 bits each)."""
    r = registers[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.int64)
    key = np.arange(BANDS, dtype=np.int64)
    for i in range(ROWS):
        key = key << 11 | r[:, i]
    return key


def _tail(x: np.ndarray) -> np.ndarray:
    """Probability that a register is the larger, from the share of elements that only its set has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def likelihood(more: np.ndarray, less: np.ndarray, share: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity j, given how many registers are larger and smaller, and the first set's share of both sizes."""
    p = np.clip(_tail(np.maximum(share - (1 - share) * j, 0)), 1e-12, 1)
    q = np.clip(_tail(np.maximum(1 - share - share * j, 0)), 1e-12, 1)
    return more * np.log(p) + less * np.log(q) + (M - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))


def may_link(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Whether the threshold is within the likelihood bound of the best similarity."""
    share = n1 / (n1 + n2)
    top = np.minimum(n1, n2) / np.maximum(n1, n2)
    at = likelihood(more, less, share, np.minimum(PERCENT / 100, top))
    below = np.max([likelihood(more, less, share, np.minimum(f, top)) for f in np.linspace(0.3, PERCENT / 100, 23)], axis=0)
    above = np.max([likelihood(more, less, share, np.minimum(f, top)) for f in np.linspace(PERCENT / 100, 1, 7)], axis=0)
    return 2 * (below - np.maximum(at, above)) <= LIKELY


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, salt) that may be linked, by the joint likelihood of their registers and known sizes.

    A hub's registers are copied once for each of its portions (a, salt).
    """
    side = lambda k: classes.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("registers").alias(f"r{k}"))
    both = pairs.join(side("b"), "b").join(pairs.select("a", "salt").distinct().join(side("a"), "a"), ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            r, q = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
            n1, n2 = (t[c].to_numpy().astype(float) for c in ("na", "nb"))
            fit = may_link((r > q).sum(axis=1), (r < q).sum(axis=1), n1, n2) & (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)) if t.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([t["a"], t["b"], t["salt"]], ["a", "b", "salt"]).filter(pa.array(fit, pa.bool_()))

    return both.select("a", "b", "salt", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, salt long")


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (digest of the set, null if empty), n_shingles, registers, keys."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "text_hash", "node", "n_shingles", "registers", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, regs, keys = [], [], [], []
            for t in b["text"].to_pylist():
                s = shingles(t)
                r = sketch(s) if len(s) else None
                n.append(len(s))
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(None if r is None else r.tobytes())
                keys.append(None if r is None else band_keys(r))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole()).alias("text_hash"), whole().alias("text")).mapInArrow(run, "doc_id long, text_hash long, node binary, n_shingles long, registers binary, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, salt, common (elements of both full sets), linked for pairs (a, b, salt).  texts: id, text.

    Pairs of one portion (a, salt) share one copy of a's text, sorted to the front; a task holds one
    such set and a batch.
    """
    first = pairs.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rest = pairs.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text")
    rows = first.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        for batch in batches:
            out = []
            for a, salt, b, text in zip(*(batch[c].to_pylist() for c in ("a", "salt", "b", "text")), strict=True):
                s = shingles(text)
                if b is None:
                    own, at = s, (a, salt)
                    continue
                if at != (a, salt):
                    raise ValueError(f"pairs of {a} came without its text")
                small, large = (s, own) if len(s) <= len(own) else (own, s)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                out.append((a, b, salt, both, 100 * both >= PERCENT * (len(s) + len(own) - both)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["a", "b", "salt", "common", "linked"])

    return rows.mapInArrow(run, "a long, b long, salt long, common long, linked boolean")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """id, component (the smallest id reachable) of all ids in edges (a, b, salt).

    An id's neighbours are held in lists, one for each salt, so that a hub of very many links
    looks up its label once for a list and not once for a link.
    """
    both = edges.select("a", "b", "salt").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "salt")).filter("a <> b")
    near = written(both.groupBy(F.col("a").alias("at"), "salt").agg(F.collect_set("b").alias("ids")), f"{folder}/near")
    label = written(near.groupBy(F.col("at").alias("id")).agg(F.min(F.least(F.col("at"), F.array_min("ids"))).alias("component")), f"{folder}/label0")
    k = 0
    while True:
        k += 1
        told = near.join(label, F.col("at") == F.col("id")).select(F.explode("ids").alias("_to"), "component").groupBy("_to").agg(F.min("component").alias("_near"))
        step = label.join(told, F.col("id") == F.col("_to")).select("id", F.least("component", "_near").alias("component"), (F.col("_near") < F.col("component")).alias("moved"))
        step = written(step, f"{folder}/step{k}")
        if not step.filter("moved").head(1):
            return step.select("id", "component")
        jump = step.select(F.col("id").alias("_to"), F.col("component").alias("_further"))
        label = written(step.join(jump, F.col("component") == F.col("_to"), "left").select("id", F.least("component", "_further").alias("component")), f"{folder}/label{k}")


def block_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b, salt) of different components that share a bucket and may be linked, each in its first common band.

    The salt names the two blocks that met, so an ``a`` has at most BLOCK pairs of one salt.

    members: key, hub, n (of the bucket), id, component, common (with the hub), n_shingles, registers.
    What both share with the hub (null: not known) bounds exactly what they can share with each other.
    A bucket of more than BLOCK members is cut into blocks by a hash of the id; each two
    blocks meet in a group of their own.
    """
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    m = members.withColumn("_k", parts).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    m = m.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    m = m.select("key", F.least("_b", "_x").alias("i"), F.greatest("_b", "_x").alias("j"), "_b", "hub", "id", "component", "common", "n_shingles", "registers")
    m = m.withColumn("_salt", F.xxhash64("key", "i", "j"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("salt", pa.int64())])

    def pairs(t: pa.Table) -> pa.Table:
        n = t.num_rows
        key, i, j = (t[c][0].as_py() for c in ("key", "i", "j"))
        r = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint16).reshape(n, M)
        ids, comp, size, block, hub = (t[c].to_numpy() for c in ("id", "component", "n_shingles", "_b", "hub"))
        common = t["common"].fill_null(-1).to_numpy()
        band, out = key >> 55, []
        least_equal = M * PERCENT / 100 - 4.5 * math.sqrt(M * 0.85 * 0.15)
        for x in range(n - 1):
            y = np.arange(x + 1, n)
            fit = (comp[y] != comp[x]) & (ids[x] != hub[x]) & (ids[y] != hub[x]) & (100 * np.minimum(size[y], size[x]) >= PERCENT * np.maximum(size[y], size[x]))
            most = np.minimum(common[y], common[x]) + np.minimum(size[y] - common[y], size[x] - common[x])
            fit &= (100 * most >= PERCENT * (size[y] + size[x] - most)) | (common[y] < 0) | (common[x] < 0)
            if i != j:
                fit &= block[y] != block[x]
            y = y[fit]
            if not len(y):
                continue
            same = r[y] == r[x]
            near = same.sum(axis=1) >= least_equal
            y, same = y[near], same[near]
            if not len(y):
                continue
            first = same[:, : ROWS * BANDS].reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1)
            y = y[first == band]
            if len(y):
                more, less = (r[x] > r[y]).sum(axis=1), (r[x] < r[y]).sum(axis=1)
                y = y[may_link(more, less, np.full(len(y), float(size[x])), size[y].astype(float))]
                out.append(np.column_stack([np.full(len(y), ids[x]), ids[y]]))
        got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        salt = np.full(len(got), t["_salt"][0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(got.min(axis=1) if len(got) else [], pa.int64()), pa.array(got.max(axis=1) if len(got) else [], pa.int64()), pa.array(salt)], schema=schema)

    return m.groupBy("key", "i", "j").applyInArrow(pairs, "a long, b long, salt long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    sets = written(set_table(docs), f"{folder}/sets")
    # a class is named by a number, not by a doc_id, which several texts may share; it is fixed once written
    classes = written(
        sets.filter("node is not null and doc_id is not null").groupBy("node").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("_r"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("keys").alias("keys")
        ).select("node", F.monotonically_increasing_id().alias("id"), F.col("_r.doc_id").alias("first_doc"), F.col("_r.text_hash").alias("text_hash"), "n_shingles", "registers", "keys"),
        f"{folder}/classes",
    )
    bands = classes.select("id", "text_hash", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(bands.join(shared, "key"), f"{folder}/members")
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = members.join(met, "id").groupBy("key").agg(F.max(F.struct("met", "text_hash", "id")).alias("_h")).select("key", F.col("_h.id").alias("hub"))
    members = written(members.drop("text_hash").join(hubs, "key"), f"{folder}/buckets")
    # a bucket's size bounds the pairs of its hub there: it tells into how many portions they go
    pairs = members.filter("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
    pairs = written(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / FAN)).alias("salt")), f"{folder}/pairs")
    wanted = met.select("id").join(classes.select("id", "first_doc", "text_hash"), "id").select("id", F.col("first_doc").alias("_doc"), "text_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(whole()).alias("text_hash"), whole().alias("text"))
    texts = written(wanted.join(texts, ["_doc", "text_hash"]).groupBy("id").agg(F.min("text").alias("text")), f"{folder}/texts")
    pairs = written(likely(pairs, classes), f"{folder}/likely")
    met_hubs = written(verify(pairs, texts), f"{folder}/links0")
    links = met_hubs.filter("linked").select("a", "b", "salt")
    found = components(links, f"{folder}/first")
    placed = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("key")
    rest = placed.join(open_keys, "key").join(classes.select("id", "n_shingles", "registers"), "id")
    shared = met_hubs.select(F.col("a").alias("hub"), F.col("b").alias("id"), "common")
    rest = rest.join(shared, ["hub", "id"], "left").withColumn("common", F.when(F.col("id") == F.col("hub"), F.col("n_shingles")).otherwise(F.col("common")))
    more = written(block_pairs(rest), f"{folder}/pairs1")
    links = links.unionByName(verify(more, texts).filter("linked").select("a", "b", "salt"))
    # rows, with their classes; documents of several texts link these
    out = written(sets.select("doc_id", "n_shingles", F.col("node").alias("_node")).join(classes.select("node", "id", "first_doc"), F.col("_node") == F.col("node"), "left").drop("_node", "node"), f"{folder}/rows")
    several = out.groupBy(F.col("doc_id").alias("_doc")).agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "first_doc"))).alias("_a"), F.max("id").alias("_hi"), F.count_if(F.col("id").isNull()).alias("_none"))
    several = written(several.filter("_doc is not null and (_a.id <> _hi or (_hi is not null and _none > 0))").select("_doc", "_a"), f"{folder}/several")
    out = out.join(several, out["doc_id"] == several["_doc"], "left")
    own = out.filter("id <> _a.id").select(F.col("_a.id").alias("a"), F.col("id").alias("b"), F.pmod(F.xxhash64("id"), F.lit(FAN)).alias("salt")).distinct()
    out = written(out.select("doc_id", "n_shingles", F.coalesce("id", "_a.id").alias("id"), F.coalesce("first_doc", "_a.first_doc").alias("first_doc")), f"{folder}/placed")
    final = components(links.unionByName(own), f"{folder}/final")
    discard(spark, *(f"{folder}/{x}" for x in ("sets", "members", "buckets", "pairs", "texts", "likely", "links0", "first", "pairs1", "rows", "several")))
    # a component is named by the smallest doc_id of its classes
    names = classes.select("id", "first_doc").join(final, "id").groupBy("component").agg(F.min("first_doc").alias("_name"))
    named = final.join(names, "component").select(F.col("id").alias("_id"), "_name")
    out = out.join(named, F.col("id") == F.col("_id"), "left")
    component = F.coalesce("_name", "first_doc", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of docs that are kept, with all their columns; rows without an id stay.

    Of rows with one id that with the smallest text stays (null first; then the smallest other columns), so reruns agree.
    """
    kept = near_duplicates(docs).filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n"))
    kept = written(kept, f"{shared_dir(docs.sparkSession)}/kept")
    with_id = lambda ids: docs.join(ids.select("_kept"), docs["doc_id"] == F.col("_kept"), "left_semi")
    # the ids kept grow with the corpus: never broadcast, at any size
    once = with_id(kept.filter("_n = 1").hint("merge"))
    # ids of several rows go by themselves, so that all others need no grouping
    others = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("_")))
    first = F.min_by(F.struct(*docs.columns), F.struct("text", others))
    several = with_id(kept.filter("_n > 1")).groupBy(F.col("doc_id").alias("_kept")).agg(first.alias("_r")).select("_r.*")
    return once.unionByName(several).unionByName(docs.filter("doc_id is null"))
