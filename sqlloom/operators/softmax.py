"""Training of the baseline over blocks of texts: term counts, features, and the steps of multinomial regression.

Texts of a block that share their common runs of characters (those without blanks) share a pattern: the terms that
come from common runs alone are listed once for the pattern, and each text lists only the terms of its other runs.
This changes no number: a text's features are its pattern's, corrected where its own terms say otherwise, over its norm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

#: Texts of a block are these many at most, and these many characters, but for the last text.
ROWS, CHARS = 16_384, 1_000_000
#: A run that occurs so often in a block is common there.
COMMON = 16
#: MB that the driver may get at a step; beyond that tasks add up first.
ONCE_MB = 64
RUN, WORD = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile(r"\w+", re.A)


def runs_of(text: str) -> list[str]:
    return RUN.findall(text.lower())


def grams_of(run: str) -> list[str]:
    """Character grams of a run without blanks, repeated ones repeated."""
    run = f" {run} "
    return [run[i : i + n] for n in range(2, 6) for i in range(max(len(run) + 1 - n, 1))]


class Pattern:
    """What texts have in common: their common runs in place, and how many words each other run has."""

    def __init__(self, key: tuple[str | int, ...]):
        words = [w for x in key for w in (WORD.findall(x) if isinstance(x, str) else [None] * x)]
        windows = [(i, i + n) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        #: Windows of the words that hold one of a text's own.
        self.own = [(i, j) for i, j in windows if None in words[i:j]]
        self.words, self.open = words, [i for i, w in enumerate(words) if w is None]
        self.runs = [x for x in key if isinstance(x, str)]
        #: Counts of word grams, of character grams.
        self.counts = Counter(" ".join(words[i:j]) for i, j in windows if None not in words[i:j]), Counter(chain.from_iterable(map(grams_of, self.runs)))


def shaped(texts: list[str | None]) -> tuple[list[Pattern], list[int], Iterator[tuple[list[str], list[str]]]]:
    """The block's patterns, each text's pattern, and one by one the texts' own word grams and own runs, repeated ones repeated."""
    runs = [runs_of(x or "") for x in texts]
    common = {r for r, n in Counter(chain.from_iterable(runs)).items() if n >= COMMON}
    places: dict[tuple, int] = {}
    at = [places.setdefault(tuple(r if r in common else len(WORD.findall(r)) for r in x), len(places)) for x in runs]
    patterns = [Pattern(k) for k in places]

    def own() -> Iterator[tuple[list[str], list[str]]]:
        for p, x in zip(at, runs, strict=True):
            rare = [r for r in x if r not in common]
            words = patterns[p].words.copy()
            for i, w in zip(patterns[p].open, chain.from_iterable(WORD.findall(r) for r in rare), strict=True):
                words[i] = w
            yield [" ".join(words[i:j]) for i, j in patterns[p].own], rare

    return patterns, at, own()


def gathered(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows, whose first element is a text, in blocks."""
    block, chars = [], 0
    for r in rows:
        block.append(r)
        chars += len(r[0] or "")
        if len(block) == ROWS or chars >= CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def term_counts(texts: list[str | None]) -> Iterator[tuple[int, dict[str, int], dict[str, int]]]:
    """For each kind of grams: how often each occurs in the texts, and in how many of them."""
    patterns, at, own = shaped(texts)
    total, texts_with = (Counter(), Counter()), (Counter(), Counter())
    for p, (words, rare) in zip(at, own, strict=True):
        for k, g in enumerate((words, [g for r in rare for g in grams_of(r)])):
            known = patterns[p].counts[k]
            total[k].update(g)
            texts_with[k].update(x for x in set(g) if x not in known)
    for p, n in Counter(at).items():
        for k, known in enumerate(patterns[p].counts):
            for g, c in known.items():
                total[k][g] += n * c
                texts_with[k][g] += n
    return ((k, total[k], texts_with[k]) for k in (0, 1))


class Block:
    """Features of texts.  Its units are the patterns' word terms, their character terms, the texts' own word terms and own character terms.

    A unit has the entries from ``start`` on: places of terms, and values.  A text's features are its units', each kind times the text's ``scale``.
    Where a pattern has an own term of one of its texts, ``value`` is the difference, and ``hit`` the entry's place in the list of ``known`` values.
    """

    FIELDS = {"y": np.int32, "pattern": np.int32, "scale": np.float64, "start": np.int64, "at": np.int32, "value": np.float64, "hit": np.int32, "known": np.float64}

    def __init__(self, **arrays: np.ndarray):
        self.__dict__ |= arrays
        self.n = len(self.y)
        self.lengths = np.diff(self.start)
        self.patterns = (len(self.lengths) - 2 * self.n) // 2

    @staticmethod
    def of(texts: list[str | None], y: list[int], places: list[dict[str, int]], idf: list[np.ndarray], sublinear: bool) -> Block:
        weigh = (lambda c: np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0.0)) if sublinear else (lambda c: c.astype(float))
        patterns, pattern, own = shaped(texts)
        known = [[{places[k][g]: c for g, c in p.counts[k].items() if g in places[k]} for p in patterns] for k in (0, 1)]
        lists = [[(list(d), list(d.values()), [0] * len(d)) for d in known[k]] for k in (0, 1)]
        mine: list[list] = [[], []]
        for p, (words, rare) in zip(pattern, own, strict=True):
            for k, g in enumerate((words, (g for r in rare for g in grams_of(r)))):
                here, c = known[k][p], Counter(places[k][x] for x in g if x in places[k])
                old = [here.get(i, 0) for i in c]
                mine[k].append((list(c), [a + b for a, b in zip(c.values(), old, strict=True)], old))
        units = [u for part in (*lists, *mine) for u in part]
        lengths = np.array([len(u[0]) for u in units], np.int64)
        at, now, old = (np.fromiter(chain.from_iterable(u[i] for u in units), np.int64, lengths.sum()) for i in range(3))
        kind = np.repeat(np.repeat([0, 1, 0, 1], [len(patterns)] * 2 + [len(texts)] * 2), lengths)
        at += kind * len(idf[0])
        weight = np.concatenate(idf)[at] if len(at) else np.zeros(0)
        now, old = weigh(now) * weight, weigh(old) * weight
        pattern = np.array(pattern, np.int32)
        squares = np.bincount(np.repeat(np.arange(len(units)), lengths), now * now - old * old, len(units))
        n, p = len(texts), len(patterns)
        norm = np.sqrt(np.maximum(np.stack([squares[pattern] + squares[2 * p : 2 * p + n], squares[p + pattern] + squares[2 * p + n :]]), 0))
        hit = np.flatnonzero(old)
        return Block(
            y=np.array(y, np.int32), pattern=pattern, scale=np.divide(1, norm, out=np.zeros_like(norm), where=norm > 0).ravel(), start=np.concatenate([[0], np.cumsum(lengths)]),
            at=at.astype(np.int32), value=now - old, hit=hit.astype(np.int32), known=old[hit],
        )

    def packed(self) -> dict[str, bytes]:
        return {k: getattr(self, k).astype(t).tobytes() for k, t in self.FIELDS.items()}

    @classmethod
    def unpacked(cls, fields: dict[str, bytes]) -> Block:
        return cls(**{k: np.frombuffer(fields[k], t) for k, t in cls.FIELDS.items()})

    def margins(self, weights: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        """Classes by texts."""
        p, n, filled = self.patterns, self.n, np.flatnonzero(self.lengths)
        units, out = np.zeros(len(self.lengths)), np.empty((len(intercept), n))
        for c, w in enumerate(weights):
            if len(filled):
                units[filled] = np.add.reduceat(w.take(self.at) * self.value, self.start[filled])
            out[c] = self.scale[:n] * (units[self.pattern] + units[2 * p : 2 * p + n]) + self.scale[n:] * (units[p + self.pattern] + units[2 * p + n :]) + intercept[c]
        return out

    def summed(self, by_text: np.ndarray, terms: int, squared: bool = False) -> np.ndarray:
        """For each term, the sum over the texts of its value (or its square) times the text's number."""
        p, first, second = self.patterns, self.scale[: self.n], self.scale[self.n :]
        if squared:
            first, second = first * first, second * second
        first, second, value = first * by_text, second * by_text, self.value
        if squared:
            known = np.zeros(len(value))
            known[self.hit] = self.known
            value = value * (value + 2 * known)
        units = np.concatenate([np.bincount(self.pattern, first, p), np.bincount(self.pattern, second, p), first, second])
        return np.bincount(self.at, np.repeat(units, self.lengths) * value, terms)


def gradient(blocks: Iterable[Block], weights: np.ndarray, intercept: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over the texts: loss, its derivatives by margins, its derivatives by weights."""
    loss, total, out = 0.0, np.zeros(len(intercept)), np.zeros(weights.shape)
    for b in blocks:
        m = b.margins(weights, intercept)
        m -= m.max(axis=0)
        texts = np.arange(b.n)
        right = m[b.y, texts]
        np.exp(m, out=m)
        whole = m.sum(axis=0)
        loss += float((np.log(whole) - right).sum())
        m /= whole
        m[b.y, texts] -= 1
        total += m.sum(axis=1)
        for c, r in enumerate(m):
            out[c] += b.summed(r, weights.shape[1])
    return loss, total, out


class _Stuck(Exception):
    pass


def _searched(f: Callable, t: float, value: float, slope: float) -> float:
    """A step of strong Wolfe conditions; f gives value and slope at a step."""

    def between(a, b):
        (s, fa, da), (e, fb, db) = sorted((a, b))
        one = da + db - 3 * (fa - fb) / (s - e)
        two = math.sqrt(max(one * one - da * db, 0))
        x = e - (e - s) * (db + two - one) / ((db - da + 2 * two) or 1)
        return min(max(x, s + 0.1 * (e - s)), s + 0.9 * (e - s))

    def zoomed(low, high):
        for _ in range(10):
            c = (x := between(low, high), *f(x))
            if c[1] > value + 1e-4 * x * slope or c[1] >= low[1]:
                high = c
            elif abs(c[2]) <= 0.9 * abs(slope):
                return x
            else:
                low, high = c, low if c[2] * (high[0] - low[0]) >= 0 else high
        raise _Stuck

    low = (0.0, value, slope)
    for i in range(10):
        c = (t, *f(t))
        if not math.isfinite(c[1]):
            t /= 2
        elif c[1] > value + 1e-4 * t * slope or (i and c[1] >= low[1]):
            return zoomed(low, c)
        elif abs(c[2]) <= 0.9 * abs(slope):
            return t
        elif c[2] >= 0:
            return zoomed(c, low)
        else:
            low, t = c, t * 1.5
    raise _Stuck


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with the line search, the memory and the ends of pyspark.ml's regression: where it has got to, and the values on the way."""
    value, slope = f(x)
    values, recent, past, failed = [value], [math.inf], [], False
    while len(values) <= steps:
        d, shares = slope.copy(), []
        for s, y, sy in past:
            shares.append(s @ d / sy)
            d -= shares[-1] * y
        if past:
            d *= past[0][2] / (past[0][1] @ past[0][1])
        for (s, y, sy), a in zip(reversed(past), reversed(shares), strict=True):
            d += (a - y @ d / sy) * s
        d = -d
        seen: dict[float, tuple] = {}

        def along(t, x=x, d=d, seen=seen):
            seen.clear()
            seen[t] = f(x + t * d)
            return seen[t][0], float(seen[t][1] @ d)

        try:
            first = float(slope @ d)
            if not first <= 0:
                raise _Stuck
            t = _searched(along, 1.0 if len(values) > 1 else 1 / (np.linalg.norm(d) or 1), value, first)
            if t * np.linalg.norm(slope) < 1e-10:
                raise _Stuck
        except _Stuck:
            if failed:
                break
            failed, past = True, []
            continue
        value, new = seen.get(t) or f(x + t * d)
        x, s, y, slope = x + t * d, t * d, new - slope, new
        past = [(s, y, s @ y), *past][:memory] if s @ y > 0 else past
        values.append(value)
        recent = [*recent, value][-10:]
        if abs(value - max(recent)) <= tolerance * abs(values[0]) or np.linalg.norm(slope) <= max(tolerance * abs(value), 1e-8):
            break
    return x, values


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _moments(blocks: Iterable[Block], classes: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by class; for each term, the sums of its values and of their squares."""
    n, first, second = np.zeros(classes), np.zeros(terms), np.zeros(terms)
    for b in blocks:
        each = np.ones(b.n)
        n += np.bincount(b.y, minlength=classes)
        first += b.summed(each, terms)
        second += b.summed(each, terms, squared=True)
    return n, first, second


def regression(data: DataFrame, features: str, classes: int, terms: int, penalty: float, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Coefficients (classes by terms), intercepts, and the objective at each step: the objective, start and scale of pyspark.ml's multinomial regression with intercepts, whose penalty is that of the terms as they are.

    Tasks keep their blocks; at every step they get the model and add up what they say of it, as a tree if it is large, so the driver holds few models.
    """
    sc, names = data.sparkSession.sparkContext, list(Block.FIELDS)
    held: RDD = data.select(*(f"{features}.{k}" for k in names)).rdd.map(lambda r: tuple(map(bytes, r))).persist(StorageLevel.MEMORY_AND_DISK)

    large = held.getNumPartitions() * classes * terms * 8 > ONCE_MB * 1e6

    def over(f: Callable[[Iterator[Block]], tuple]) -> tuple:
        said = held.mapPartitions(lambda part: [f(Block.unpacked(dict(zip(names, b, strict=True))) for b in part)])
        return said.treeReduce(_added) if large else said.reduce(_added)

    by_class, first, second = over(lambda blocks: _moments(blocks, classes, terms))
    n = by_class.sum()
    mean, square = first / n, second / n
    spread = (square - mean * mean) * n / max(n - 1, 1)
    # what is left of a constant's square is rounding
    spread[spread <= 1e-10 * square] = 0
    scale = np.divide(1, np.sqrt(spread), out=np.zeros(terms), where=spread > 0)

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = v[classes:].reshape(classes, terms) * scale
        return weights, v[:classes] - weights @ mean

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        model = parts(v)
        sent = sc.broadcast(model)
        loss, by_margin, by_weight = over(lambda blocks: gradient(blocks, *sent.value))
        sent.destroy()
        slope = (by_weight - by_margin[:, None] * mean) * (scale / n) + penalty * scale * model[0]
        return loss / n + penalty / 2 * float((model[0] ** 2).sum()), np.concatenate([by_margin / n, slope.ravel()])

    # classes beyond the last that occurs start at nothing
    begin, start = np.zeros(classes * (terms + 1)), np.log1p(np.trim_zeros(by_class, "b"))
    begin[: len(start)] = start - start.mean()
    try:
        v, values = minimised(objective, begin, steps, tolerance)
    finally:
        held.unpersist()
    weights, intercept = parts(v)
    return weights, intercept - intercept.mean(), values
