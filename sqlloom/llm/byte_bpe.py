r"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+

is a small automaton over character classes.  A whole batch of texts becomes
one array of code points; class tables and two characters of look-ahead give
each place a symbol; each symbol stands for a transition function on the
automaton's states; functions compose associatively, so a blocked scan over
their ids (composition is a table look-up) yields the state before every
character, and with it every boundary.  No regular expression is run.

Slices go to pair merging, remembered per worker.  The byte offset of every
token is retained, so decoding is one gather from the vocabulary's bytes.

Defined results: a null text counts as empty (no tokens); repeated rows and
ids each give a row; an empty table gives an empty table; other columns are
ignored.  Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole

MEMO_PIECES, MEMO_BYTES = 600_000, 64
L, N, O, SPACE, WHITE, END = range(6)  # classes
#: Symbols: letter, number, other, apostrophe opening a contraction of 2 or 3 characters,
#: blank that joins what follows, other white space before non-space, white space in a run, end of a text.
SYMBOLS = ("L", "N", "O", "A2", "A3", "J", "K", "R", "E")
#: States after a character: inside letters, numbers, others, a run of white space; after a joining blank;
#: before a fresh token; one or two characters of a contraction to come.
STATES = ("L", "N", "O", "R", "J", "F", "C1", "C2")
FRESH = STATES.index("F")
BLOCK = 256
#: Characters that are worked on together, beyond one long text.
CHARS_AT_ONCE = 1_000_000


def _step(state: str, symbol: str) -> tuple[str, bool]:
    """The next state, and whether a token begins before this character."""
    if symbol == "E":
        return "F", True
    if state in ("C1", "C2"):
        return ("F" if state == "C1" else "C1"), False
    if symbol in ("L", "N", "O"):
        return symbol, state not in (symbol, "J")
    if symbol in ("A2", "A3"):
        return ("O", False) if state in ("O", "J") else ("C1" if symbol == "A2" else "C2", True)
    if symbol == "R":
        return "R", state != "R"
    return ("J" if symbol == "J" else "F"), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols' functions, composition table (first, then second), results by id and state, boundary by state and symbol."""
    own = [tuple(STATES.index(_step(s, x)[0]) for s in STATES) for x in SYMBOLS]
    maps = list(dict.fromkeys([tuple(range(len(STATES))), *own]))
    ids = {f: i for i, f in enumerate(maps)}
    for f in maps:  # grows until closed
        for g in own:
            if (h := tuple(g[s] for s in f)) not in ids:
                ids[h] = len(maps)
                maps.append(h)
    compose = np.array([[ids[tuple(g[s] for s in f)] for g in maps] for f in maps], np.uint16)
    return np.array([ids[f] for f in own], np.uint16), compose, np.array(maps, np.uint8), np.array([[_step(s, x)[1] for x in SYMBOLS] for s in STATES])


class PreTokenizer:
    def __init__(self) -> None:
        self.ids, self.compose, self.apply, self.edge = _monoid()
        self.flat, self.n = self.compose.ravel(), len(self.compose)
        table = np.full(0x110001, O, np.uint8)
        for cp in range(0x110000):
            k = unicodedata.category(chr(cp))[0]
            if k in "LN":
                table[cp] = L if k == "L" else N
        #: Code points with the White_Space property.
        for cp in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            table[cp] = WHITE
        table[0x20], table[0x110000] = SPACE, END
        self.table = table

    def prefix(self, f: np.ndarray) -> np.ndarray:
        """Inclusive scan: the composition of all functions up to each place."""
        n = len(f)
        if n <= BLOCK:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.compose[out[i - 1], out[i]]
            return out
        rows = -(-n // BLOCK)
        grid = np.zeros(rows * BLOCK, np.uint16)  # id 0 is the identity
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
        for j in range(1, BLOCK):
            grid[j] = self.flat[grid[j - 1].astype(np.int32) * self.n + grid[j]]
        before = np.concatenate([np.zeros(1, np.uint16), self.prefix(grid[-1])[:-1]]).astype(np.int32) * self.n
        grid = self.flat[before[None, :] + grid]
        return np.ascontiguousarray(grid.T).ravel()[:n]

    def boundaries(self, cps: np.ndarray) -> np.ndarray:
        """Places at which tokens begin; texts are set apart by code point 0x110000, which counts as a token of its own."""
        k = self.table[cps]
        next1 = np.concatenate([cps[1:], np.array([0x110000], cps.dtype)])
        follows = np.concatenate([k[1:], np.array([END], np.uint8)])
        sym = np.array([0, 1, 2, 7, 7, 8], np.uint8)[k]
        solid = follows <= O
        sym[(k == SPACE) & solid] = 5
        sym[(k == WHITE) & solid] = 6
        at = np.flatnonzero(cps == 0x27)
        if len(at):
            a, b = next1[at], np.concatenate([next1, np.array([0x110000], cps.dtype)])[at + 1]
            two = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            sym[at[two]], sym[at[three]] = 3, 4
        scan = self.prefix(self.ids[sym])
        before = np.concatenate([np.array([FRESH], np.uint8), self.apply[scan[:-1], FRESH]])
        return np.flatnonzero(self.edge[before, sym])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


NONE = np.int64(1 << 40)


class Merger:
    """Pair merging of many short pieces at once.

    Each round joins, in every piece that still has a pair of known rank, the
    leftmost pair of the lowest rank; only the two pairs beside it are looked
    up again.  Pieces without such a pair leave the round.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.keys, self.found = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right = np.meshgrid(self.single, self.single, indexing="ij")
        self.two = self.rank(left.ravel(), right.ravel()).reshape(256, 256)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], NONE)

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[tuple[int, ...]] = [()] * len(pieces)
        ids, seg = self.single[raw], np.repeat(np.arange(len(pieces)), size)
        cost = np.full(len(ids), NONE)
        cost[:-1] = np.where(seg[1:] == seg[:-1], self.two[raw[:-1], raw[1:]], NONE)
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            low = np.minimum.reduceat(cost, start)
            if (over := low >= NONE).any():
                ends, flat = np.append(start[1:], len(ids)), ids.tolist()
                for k, i, j in zip(seg[start[over]].tolist(), start[over].tolist(), ends[over].tolist(), strict=True):
                    out[k] = tuple(flat[i:j])
                keep = np.repeat(~over, ends - start)
                ids, seg, cost = ids[keep], seg[keep], cost[keep]
                continue
            at = np.flatnonzero(cost == np.repeat(low, np.diff(np.append(start, len(ids)))))
            at = at[np.concatenate([[True], seg[at[1:]] != seg[at[:-1]]])]
            ids[at] = low  # in this vocabulary a token's id is its rank
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one place is gone for each join before it
            ids, seg, cost = ids[keep], seg[keep], cost[keep]
            for i in (at, at - 1):
                i = i[i >= 0]
                j = np.minimum(i + 1, len(ids) - 1)
                cost[i] = np.where((j > i) & (seg[i] == seg[j]), self.rank(ids[i], ids[j]), NONE)
        return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for one long piece, with a heap and links."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j], right[i] = b"", right[j]
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return tuple(ranks[p] for p in parts if p)


class Codec:
    def __init__(self, path: str) -> None:
        self.ranks, self.pre = load_ranks(path), PreTokenizer()
        self.merger = Merger(self.ranks)
        self.memo: dict[str, tuple[int, ...]] = {}
        words = sorted((i, b) for b, i in self.ranks.items())
        size = words[-1][0] + 1
        self.length = np.zeros(size, np.int64)
        for i, b in words:
            self.length[i] = len(b)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(b for _, b in words), np.uint8)
        self.decimal = [str(i) for i in range(size)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids begin (and the last end)."""
        ids, sizes, at = [np.zeros(0, np.int32)], [[0]], 0
        while at < len(texts):
            to, n = at + 1, len(texts[at])
            while to < len(texts) and n + len(texts[to]) <= CHARS_AT_ONCE:
                n, to = n + len(texts[to]), to + 1
            own, bounds = self._encode(texts[at:to])
            ids.append(own)
            sizes.append(np.diff(bounds))
            at = to
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\x00".join([*texts, ""])
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cps[ends] = 0x110000
        at = self.pre.boundaries(cps)
        cut = np.append(at, len(cps)).tolist()
        pieces = [joined[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        closing = np.searchsorted(at, ends)  # the pieces that stand for the ends of texts
        memo, long = self.memo, {}
        for p in closing.tolist():
            pieces[p] = ""
        new = set(pieces).difference(memo)
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = set(pieces)
        memo[""] = ()
        new.discard("")
        short = []
        for p in new:
            b = p.encode()
            if b in self.ranks:
                memo[p] = (self.ranks[b],)
            elif len(b) <= MEMO_BYTES:
                short.append((p, b))
            else:
                long[p] = merge_long(b, self.ranks)
        if short:
            memo.update(zip((p for p, _ in short), self.merger([b for _, b in short]), strict=True))
        got = [memo[p] if p in memo else long[p] for p in pieces] if long else list(map(memo.__getitem__, pieces))
        counts = np.fromiter(map(len, got), np.int64, len(got))
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(total[-1]))
        return ids, np.concatenate([[0], total[closing + 1]])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins, and the end of the last."""
        return np.concatenate([[0], np.cumsum(self.length[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        at, n = self.offsets(ids), self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - at[:-1], n) + np.arange(at[-1])].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<long> (bytes; one more than ids)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for b in batches:
            ids, at = c.encode(b["text"].to_pylist())
            parts = [ids[i:j] for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(parts, pa.list_(pa.int32())), pa.array([c.offsets(p) for p in parts], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode_ids(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([c.decode(np.asarray(x, np.int64)) for x in b["ids"].to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def bpe_digests(docs: DataFrame, vocab_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encodes, decodes the ids, and digests both."""
    bounded_batches(docs.sparkSession)
    more = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for b in batches:
            ids, at = c.encode(b["text"].to_pylist())
            n, a, d, kept = [], [], [], []
            for i, j in zip(at.tolist(), at[1:].tolist(), strict=False):
                own = ids[i:j]
                n.append(j - i)
                a.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, own.tolist())).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(own)).hexdigest())
                kept.append(own)
            cols = [b["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(kept, pa.list_(pa.int32()))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
            yield pa.RecordBatch.from_arrays(cols[: 4 + with_ids], names[: 4 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
