"""Elias-Fano sequences and n-gram levels that are read from memory-mapped bytes."""

from __future__ import annotations

import io
import mmap
import struct
import tempfile

import numpy as np

U = np.uint64
#: Bits of a successor's number within its context, and representative values of a level (code 0: absent).
FINGER, CODES = 40, 255


def packed_bits(v: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after another in 64-bit words."""
    words = np.zeros(len(v) * width // 64 + 2, U)
    if not width or not len(v):
        return words
    v = v & U((1 << width) - 1)
    at = np.arange(len(v), dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[starts]] = np.bitwise_or.reduceat(v << shift, starts)
    spill = np.flatnonzero(shift + U(width) > U(64))  # at most one value of each word
    words[word[spill] + 1] |= v[spill] >> (U(64) - shift[spill])
    return words


def _select_in(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each word."""
    at = np.zeros(len(word), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(word & U((1 << s) - 1)).astype(np.int64)
        go = r >= c
        r = np.where(go, r - c, r)
        word = np.where(go, word >> U(s), word)
        at += s * go
    return at


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary.  Look-ups take arrays."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def of(v: np.ndarray) -> EliasFano:
        v, n = v.astype(U), len(v)
        top = int(v[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (v >> U(width)).astype(np.int64) + np.arange(n, dtype=np.int64)
        high = np.zeros((int(at[-1]) if n else 0) // 64 + 2, U)
        if n:
            word = at >> 6
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            high[word[starts]] = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), starts)
        return EliasFano(n, width, packed_bits(v, width), high)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U)
        over = np.where(shift > U(0), self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (self.low[word] >> shift | over) & U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in(self.high[word], i - self.ones[word])
        return (place - i).astype(U) << U(self.width) | self.low_bits(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Values before the k-th zero of the high part: those below bucket k + 1."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _select_in(~self.high[word], k - self.zeros[word]) - k

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that is not below each x (n if there is none), and whether it is x."""
        x = x.astype(U)
        bucket = x >> U(self.width)
        inside = bucket < U(self.zeros[-1])
        out, same = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        b = bucket[inside].astype(np.int64)
        lo, end = np.where(b > 0, self._zero(np.maximum(b - 1, 0)), 0), self._zero(b)
        goal, hi = x[inside] & U((1 << self.width) - 1), end.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.low_bits(mid) < goal[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        found = lo < end
        hit = np.zeros(len(lo), bool)
        hit[found] = self.low_bits(lo[found]) == goal[found]
        out[inside], same[inside] = lo, hit
        return out, same

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high]


def blob(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one run of bytes, each at a multiple of 8."""
    out = io.BytesIO()
    out.write(struct.pack("<q", len(arrays)))
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        out.write(struct.pack("<8sq", a.dtype.str.encode(), len(raw)) + raw + bytes(-len(raw) % 8))
    return out.getvalue()


def mapped(data: bytes) -> list[np.ndarray]:
    """The arrays of a blob over a memory-mapped scratch file, which has no name and ends with its task."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        view = mmap.mmap(f.fileno(), len(data), access=mmap.ACCESS_READ)
    (n,), at, out = struct.unpack_from("<q", view, 0), 8, []
    for _ in range(n):
        kind, size = struct.unpack_from("<8sq", view, at)
        out.append(np.frombuffer(view, np.dtype(kind.rstrip(b"\0").decode()), size // np.dtype(kind.rstrip(b"\0").decode()).itemsize, at + 16))
        at += 16 + size + -size % 8
    return out


class Words:
    """The first level: sorted word hashes with their counts."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        head, low, high, self.counts = arrays
        self.hashes = EliasFano(int(head[0]), int(head[1]), low, high)

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray) -> bytes:
        kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8
        return blob([*EliasFano.of(hashes).arrays(), counts.astype(kind)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The counts, 0 where a word is absent."""
        at, same = self.hashes.successor(hashes)
        out = np.zeros(len(hashes), np.int64)
        out[same] = self.counts[at[same]]
        return out


def quantised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 1 and their centres: the values themselves where they are few, else means of bins of equal numbers of values."""
    values, inverse, n = np.unique(p, return_inverse=True, return_counts=True)
    if len(values) <= CODES:
        bins = np.arange(len(values))
    else:
        bins = np.minimum((np.cumsum(n) - n // 2) * CODES // n.sum(), CODES - 1)
    total, weight = np.bincount(bins, values * n, CODES), np.bincount(bins, n, CODES)
    centres = np.zeros(CODES + 1, np.float32)
    centres[1:] = total / np.maximum(weight, 1)
    return (bins[inverse] + 1).astype(np.uint8), centres


class Successors:
    """The second level: contexts, monotone pointers into their successors, and quantised probabilities.

    The successors of all contexts make one increasing sequence: each is stored relative to its context, as
    what is added to the last value of the context before.  A search is thus for that value plus the successor's number.
    """

    def __init__(self, arrays: list[np.ndarray]) -> None:
        c, p, s, (self.codes, self.centres) = arrays[:3], arrays[3:6], arrays[6:9], arrays[9:]
        self.contexts, self.pointers, self.successors = (EliasFano(int(h[0]), int(h[1]), low, high) for h, low, high in (c, p, s))

    @staticmethod
    def build(contexts: np.ndarray, fans: np.ndarray, fingers: np.ndarray, p: np.ndarray) -> bytes:
        """Sorted contexts, how many successors each has, their sorted numbers, their log10 probabilities."""
        ends = np.cumsum(fans)
        tops = fingers[ends - 1].astype(U) + U(1) if len(ends) else np.zeros(0, U)
        base = np.concatenate([np.zeros(1, U), np.cumsum(tops)[:-1]]) if len(ends) else tops
        if len(tops) and len(tops) >> (63 - FINGER):
            raise ValueError("too many contexts in one shard")
        codes, centres = quantised(p)
        sequence = fingers.astype(U) + U(1) + np.repeat(base, fans)
        return blob([*EliasFano.of(contexts).arrays(), *EliasFano.of(np.concatenate([[0], ends])).arrays(), *EliasFano.of(sequence).arrays(), codes, centres])

    def find(self, contexts: np.ndarray, fans: np.ndarray, fingers: np.ndarray) -> np.ndarray:
        """Codes of the given successors (``fans`` of them for each context), 0 where absent."""
        at, known = self.contexts.successor(contexts)
        at = np.where(known, at, 0)
        if not self.contexts.n:
            return np.zeros(len(fingers), np.uint8)
        begin, end = self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)
        base = np.where(begin > 0, self.successors.access(np.maximum(begin - 1, 0)), U(0))
        known, end, base = np.repeat(known, fans), np.repeat(end, fans), np.repeat(base, fans)
        place, same = self.successors.successor(base + fingers.astype(U) + U(1))
        same &= known & (place < end)
        out = np.zeros(len(fingers), np.uint8)
        out[same] = self.codes[place[same]]
        return out
