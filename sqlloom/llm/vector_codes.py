r"""Vector code compression: product quantisation by Lloyd rounds over heaps.

Vectors are cut into equal consecutive parts; each part position has a codebook.  A round assigns every part to
its nearest entry, then moves each entry to its parts' mean.

A block of vectors (an Arrow batch of one partition) keeps, for each entry of each position, a heap of the parts
assigned to it.  A part's key is the lower bound of its distance to any other entry less the upper bound of that
to its own, plus the drift that had accumulated when it was pushed.  When entries move, their own drift and the largest of
the others is added to the entry's account; a bound can only have been violated where the key is within the account,
so just these parts are popped, compared with all entries exactly, and pushed onto the heap of their nearest.  The parts
left are still nearest to their entry, with no tie.  Heaps lie in arrays in sorted order, so the parts to pop are a
prefix.  A block reports only how the sums of entries change; Spark adds these up by (position, entry).

State between rounds is a table in the shared folder, so a lost executor repeats its blocks of one round only.
The driver holds the codebooks (parts x entries x width numbers) and nothing that grows with the rows.

Defined results: vectors that are null or empty or hold null or non-finite components are dropped; so are those of another length than the
vector of the smallest id; where the length is no multiple of the number of parts, zeros are appended; components
beyond +-65,536 count as that; of repeated ids the smallest vector stands for it among the first entries, and each row is encoded; null ids
are encoded but begin no codebook (with no other id: nothing is); fewer ids than entries give fewer entries; ties go to the lower
index; null labels are a label; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, shared_dir, written

#: Vectors of a block; the largest magnitude of a component, times SCALE.
BLOCK, SCALE, LARGEST = 4096, 256.0, 1 << 24
#: What rounding may add to a difference of distances: absolutely, and for each unit of the largest component.
SLIP, SLIP_OF = 1e-6, 1e-9


def whole_numbers(vectors: pa.Array, n: int, parts: int) -> np.ndarray:
    """Integers of n vectors of one length, [n, parts, width]."""
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    v = np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64)
    if v.shape[1] % parts:
        v = np.pad(v, ((0, 0), (0, parts - v.shape[1] % parts)))
    return v.reshape(n, parts, -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parts x of one position: the nearest entry (lowest of ties), its squared distance, and that of the second."""
    best, second, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for e, c in enumerate(book):
        d = np.square(x - c).sum(axis=1)
        less = d < best
        second = np.where(less, best, np.minimum(second, d))
        best = np.where(less, d, best)
        at[less] = e
    return at, best, second


class Heaps:
    """For each slot (position and entry) the parts assigned to it, smallest key first."""

    def __init__(self, slots: int, lengths: np.ndarray | None = None, keys: np.ndarray | None = None, parts: np.ndarray | None = None) -> None:
        edges = np.concatenate([[0], np.cumsum(lengths)]) if lengths is not None else np.zeros(slots + 1, np.int64)
        self.keys = [keys[a:b] if keys is not None else np.zeros(0) for a, b in zip(edges, edges[1:])]
        self.parts = [parts[a:b] if parts is not None else np.zeros(0, np.int32) for a, b in zip(edges, edges[1:])]

    def pop(self, slot: int, account: float) -> np.ndarray:
        """Removes and returns the parts whose key is within the account."""
        k = int(np.searchsorted(self.keys[slot], account, "right"))
        out = self.parts[slot][:k]
        self.keys[slot], self.parts[slot] = self.keys[slot][k:], self.parts[slot][k:]
        return out

    def push(self, slot: int, keys: np.ndarray, parts: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, parts = keys[order], parts[order].astype(np.int32)
        at = np.searchsorted(self.keys[slot], keys, "right")
        self.keys[slot], self.parts[slot] = np.insert(self.keys[slot], at, keys), np.insert(self.parts[slot], at, parts)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([len(k) for k in self.keys], np.int32), np.concatenate(self.keys), np.concatenate(self.parts)


def rescan(x: np.ndarray, books: np.ndarray, account: np.ndarray, assigned: np.ndarray, heaps: Heaps, popped: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Assigns the popped parts (by position) exactly and pushes them; returns how counts and sums of slots change."""
    n, parts, width = x.shape
    entries = books.shape[1]
    count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for p, rows in popped.items():
        if not len(rows):
            continue
        v = x[rows, p]
        at, best, second = nearest(v, books[p])
        before = assigned[rows, p]
        for sign, slots, moved in ((-1, before, before >= 0), (1, at, np.ones(len(at), bool))):
            moved = moved & (before != at)
            count[p] += sign * np.bincount(slots[moved], minlength=entries)
            for j in range(width):
                np.add.at(total[p, :, j], slots[moved], sign * v[moved, j])
        assigned[rows, p] = at
        slack = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(float)) - np.sqrt(best.astype(float)))
        keys = slack + account[p, at]
        for e in np.unique(at):
            own = at == e
            heaps.push(p * entries + int(e), keys[own], rows[own])
    return count, total


def violated(heaps: Heaps, account: np.ndarray, slip: float) -> dict[int, np.ndarray]:
    parts, entries = account.shape
    return {p: np.concatenate([heaps.pop(p * entries + e, account[p, e] + slip) for e in range(entries)]).astype(np.int64) for p in range(parts)}


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What each entry's account grows by: its own way and the longest of the other entries of its position."""
    way = np.sqrt(np.square(new - old).sum(axis=2).astype(float))
    order = np.sort(way, axis=1)
    longest, next_ = order[:, -1:], order[:, -2:-1] if way.shape[1] > 1 else np.zeros((len(way), 1))
    return way + np.where(way == longest, np.where((way == longest).sum(axis=1, keepdims=True) > 1, longest, next_), longest)


STATE = "ids array<long>, labels array<{label}>, x binary, assigned binary, lengths binary, keys binary, parts binary, changes array<struct<slot: int, n: long, sums: array<long>>>"
CHANGES = pa.list_(pa.struct([("slot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _changes(count: np.ndarray, total: np.ndarray) -> pa.Array:
    entries, some = count.shape[1], np.argwhere((count != 0) | (total != 0).any(axis=2))
    rows = [{"slot": int(p * entries + e), "n": int(count[p, e]), "sums": total[p, e].tolist()} for p, e in some]
    return pa.array([rows], CHANGES)


def _state(ids: pa.Array, labels: pa.Array, x: np.ndarray, assigned: np.ndarray, heaps: Heaps, changes: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    blobs = [x.astype(np.int32), assigned.astype(np.uint8), *heaps.arrays()]
    one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a).cast(kind)
    cells = [one(ids, schema.field("ids").type), one(labels, schema.field("labels").type), *(pa.array([b.tobytes()], pa.binary()) for b in blobs), changes]
    return pa.RecordBatch.from_arrays(cells, schema=schema)


def _opened(t: pa.RecordBatch, i: int, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray, Heaps]:
    blob = lambda c, kind: np.frombuffer(t[c][i].as_py(), kind)
    x = blob("x", np.int32).reshape(-1, parts, width).astype(np.int64)
    return x, blob("assigned", np.uint8).reshape(-1, parts).astype(np.int64), Heaps(parts * entries, blob("lengths", np.int32), blob("keys", np.float64), blob("parts", np.int32))


def encode_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each kept row as a written table, and the codebooks [parts, entries, width]."""
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = kept.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd))
    label = kept.schema["label"].dataType.simpleString()
    out_schema = f"vec_id long, label {label}, code string, error long"
    # the smallest ids: ids alone are shuffled, partly folded; then one vector for each
    length = kept.filter("vec_id IS NOT NULL").agg(F.min(F.struct("vec_id", F.size("v").alias("n"))).alias("m")).first()["m"]
    if length is None:
        return spark.createDataFrame([], out_schema), np.zeros((parts, 0, 0), np.int64)
    kept = kept.filter(F.size("v") == length["n"])
    first = [r[0] for r in kept.select("vec_id").filter("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries).collect()]
    start = kept.filter(F.col("vec_id").isin(first)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    books = whole_numbers(pa.array([r["v"] for r in start], pa.list_(pa.float64())), len(start), parts).transpose(1, 0, 2)
    (_, entries, width), account = books.shape, np.zeros(books.shape[:2])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = whole_numbers(b["v"], b.num_rows, parts)
            heaps, assigned = Heaps(parts * entries), np.full(x.shape[:2], -1)
            count, total = rescan(x, books, account, assigned, heaps, {p: np.arange(len(x)) for p in range(parts)})
            yield _state(b["vec_id"], b["label"], x, assigned, heaps, _changes(count, total), schema)

    def again(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                x, assigned, heaps = _opened(t, i, parts, entries, width)
                slip = SLIP + SLIP_OF * float(np.abs(x).max()) * width
                count, total = rescan(x, books, account, assigned, heaps, violated(heaps, account, slip))
                ids, labels = t["ids"].slice(i, 1).flatten(), t["labels"].slice(i, 1).flatten()
                if not last:
                    yield _state(ids, labels, x, assigned, heaps, _changes(count, total), schema)
                    continue
                error = np.square(x - books[np.arange(parts)[None, :], assigned]).sum(axis=(1, 2))
                digits = assigned.astype(np.uint8).tobytes().hex()
                codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    schema_sql = STATE.format(label=label)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], schema_sql).schema)
    with arrow_rows(spark, BLOCK):
        state = written(kept.mapInArrow(begin, schema_sql), f"{folder}/state0")
    counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for k in range(rounds):
        change = state.select(F.explode("changes").alias("c")).select("c.slot", "c.n", F.posexplode("c.sums").alias("j", "s"))
        for r in change.groupBy("slot", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            p, e = divmod(r["slot"], entries)
            sums[p, e, r["j"]] += r["s"]
            if r["j"] == 0:
                counts[p, e] += r["n"]
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        account, books = account + drifts(books, new), new
        last = k == rounds - 1
        after = state.mapInArrow(lambda batches, last=last: again(batches, last), out_schema if last else schema_sql)
        # a row of the state is a block
        with arrow_rows(spark, 1):
            state, old = written(after, f"{folder}/{'codes' if last else f'state{k + 1}'}"), f"{folder}/state{k}"
        discard(spark, old)
    return state, books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry, position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    codes, books = encode_vectors(vectors, **parameters)
    # written, so that Spark knows its size and broadcasts it where it is small; beyond that labels are joined by a shuffle that is split where it is skewed
    sums = written(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), f"{shared_dir(spark)}/labels")
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
