r"""Secret scans: three base patterns, and guess costs of values in credential contexts.

Base spans, leftmost and non-overlapping for each kind, of whole texts:

- ``assign``: (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+),
  letters in either case, value of 6 characters or more;
- ``access``: AKIA[A-Z0-9]+ of 20 characters or more;
- ``hex``: [0-9a-f]+ of 24 characters or more.

Added by the method: values after a wider set of credential words (``pwd``,
``passphrase``, ``login`` ..., also "password is ...") whose guess cost is
high, base spans' own values among them.  The cost is the cheapest segmentation, by dynamic programming over the
value's ends, into words of a ranked dictionary (in any case, with common substitutions), dates, repeats, keyboard
walks, sequences and brute-force characters; it is a base-10 logarithm of guesses.  A value that costs at least
``LEAST_COST`` is reported as kind ``guess``, with the value's own span.
After "is", where prose goes on as well, the value must mix classes of characters too.

The dictionary is the file of a public tokenizer: its whole words by rank, after a few frequent passwords.
The work is linear in the length of a value: words and dates that can end at a place are bounded in number;
walks, sequences and repeats of any length carry the cheapest cost of the run so far.

Defined results: a null text counts as empty and has no spans; a very long text is scanned whole, and a very long
value only until no cheap segmentation is left; repeated rows and ids each give a row, and equal spans go by start,
then kind, then end; an empty table gives an empty table; other columns are ignored when finding and kept as they are
when masking, whatever their names.  Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Credential contexts beyond the base pattern, also after a prefix joined by "_" (DB_PASSWORD, aws_secret_access_key); the value runs to white space or a closing mark.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|login|pin|credentials?|auth|bearer|(?:api|access|private|secret)[_-]?key)["']?(?:\x20*[:=]\x20*|\x20is\x20)["']?([^\s"'`,;<>(){}\[\]]+)""", re.I | re.A)
LEAST_COST, LEAST_CHARS = 8.0, 6

#: Frequent passwords and words of credentials, most frequent first.
PASSWORDS = (
    "password", "admin", "welcome", "letmein", "login", "monkey", "dragon", "master", "secret", "sunshine", "princess",
    "football", "baseball", "shadow", "superman", "michael", "jordan", "hunter", "summer", "winter", "spring", "autumn",
    "hello", "freedom", "whatever", "trust", "love", "test", "user", "root", "guest", "pass", "changeme", "default",
    "example", "demo", "system", "server", "access", "token", "key", "iloveyou", "passwd", "required", "none", "null",
)
#: The rows of a keyboard, plain and with shift, and how many places each row's first key is from the left.
KEYS = (("`1234567890-=", "~!@#$%^&*()_+", 0), ("qwertyuiop[]\\", "QWERTYUIOP{}|", 1), ("asdfghjkl;'", 'ASDFGHJKL:"', 1), ("zxcvbnm,./", "ZXCVBNM<>?", 1))
#: Each row lies half a key further right: a key's place in half keys.
PLACE = {c: (r, 2 * (i + at) + r) for r, (plain, shifted, at) in enumerate(KEYS) for row in (plain, shifted) for i, c in enumerate(row)}
LEET = tuple(str.maketrans("013457@$!+", f"o{one}eastasit") for one in "il")
#: Digits of guesses: a segment more, a capital letter or a substitution, where a walk starts, a turn of it, a sequence, a repetition.
STEP, VARIED, WALK, BEND, SEQUENCE, REPEAT = 0.3, 0.3, 1.67, 0.8, 1.4, 0.5
LONGEST, UNIT = 24, 8


@lru_cache(maxsize=4)
def ranks(path: str | None) -> dict[str, float]:
    """word: digits of guesses until it comes up, by its rank among the whole words of a tokenizer's vocabulary file."""
    words = list(PASSWORDS)
    if path:
        vocab = json.loads(Path(path).read_text())["model"]["vocab"]
        found = (w.removesuffix("</w>") for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>"))
        words += [w for w in found if 3 <= len(w) <= LONGEST and w.isascii() and w.isalpha()]
    return {w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys(words))}


def _shapes() -> dict[str, list[tuple[slice, slice, slice]]]:
    """Dates by their form, digits as 0: the places of year, month and day."""
    out: dict[str, list] = {}
    for sep in ("", "-", "/", ".", "_"):
        for order in ("ymd", "dmy", "mdy"):
            for y in (4, 2):
                for m, d in ((2, 2),) if not sep else ((2, 2), (1, 2), (2, 1), (1, 1)):
                    size, at, place = {"y": y, "m": m, "d": d}, 0, {}
                    for part in order:
                        place[part] = slice(at, at + size[part])
                        at += size[part] + len(sep)
                    out.setdefault(sep.join("0" * size[x] for x in order), []).append((place["y"], place["m"], place["d"]))
    return out


DATES = _shapes()
DATE_SIZES = sorted({*map(len, DATES), 4})
ZEROS = str.maketrans("123456789", "000000000")


def date_cost(s: str, shape: str) -> float:
    """Digits of guesses of a date or year; infinite for anything else."""
    if shape == "0000" and 1900 <= int(s) <= 2049:
        return 2.1
    for y, m, d in DATES.get(shape, ()):
        if 1 <= int(s[m]) <= 12 and 1 <= int(s[d]) <= 31 and (len(s[y]) == 2 or 1900 <= int(s[y]) <= 2049):
            return 4.6
    return math.inf


def word_cost(s: str, low: str, ranked: dict[str, float]) -> float:
    """Digits of guesses of a word, with its capitals and substitutions; infinite for anything else."""
    best = ranked.get(low, math.inf)
    for table in LEET:
        plain = low.translate(table)
        if plain in ranked:
            best = min(best, ranked[plain] + VARIED * sum(x != y for x, y in zip(low, plain, strict=True)))
    if best == math.inf or s == low:
        return best
    capitals = sum(x != y for x, y in zip(s, low, strict=True))
    return best + VARIED * (1 if s.isupper() or (capitals == 1 and s[0] != low[0]) else capitals)


#: What sets a value after "is" apart from prose: signs, digits with letters, turns from small to capital letters.
PIECE, SIGN, TURN = re.compile(r"[-'’./:_–—]+"), re.compile(r"[!@#$%^&*+=~?|\\]"), re.compile(r"[a-z][A-Z]")


def brute_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.islower() or c.isupper() else math.log10(33)


def _walk_step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbouring one."""
    if a in PLACE and b in PLACE:
        (r, x), (q, y) = PLACE[a], PLACE[b]
        if (r == q and abs(x - y) == 2) or (abs(r - q) == 1 and abs(x - y) == 1):
            return q - r, y - x
    return None


def _next_step(a: str, b: str) -> int:
    """1 or -1 where b follows or precedes a among digits, small or capital letters; else 0."""
    step = ord(b) - ord(a)
    return step if abs(step) == 1 and any(kind(a) and kind(b) for kind in (str.isdigit, str.islower, str.isupper)) else 0


def guess_cost(value: str, path: str | None = None, enough: float = math.inf) -> float:
    """Base-10 logarithm of the guesses that the cheapest segmentation needs; stops at a lower bound that is ``enough``."""
    ranked, n, low, shape = ranks(path), len(value), value.lower(), value.translate(ZEROS)
    if len(low) != n:  # a few capitals become two characters
        low = value
    best = [0.0] + [math.inf] * n
    walk, sequence = math.inf, math.inf  # cheapest cost of a run that ends here and may go on
    again = [[math.inf] * UNIT for _ in range(UNIT + 1)]  # by unit: the same for repeats, at the last places
    turn: tuple[tuple[int, int] | None, int] = (None, 0)
    for end in range(1, n + 1):
        c = value[end - 1]
        cost = best[end - 1] + brute_cost(c)
        for size in range(3, min(LONGEST, end) + 1):
            start = end - size
            if best[start] + STEP < cost:
                cost = min(cost, best[start] + word_cost(value[start:end], low[start:end], ranked) + STEP)
        if shape[end - 1] == "0":
            for size in DATE_SIZES:
                if size <= end:
                    cost = min(cost, best[end - size] + date_cost(value[end - size : end], shape[end - size : end]) + STEP)
        step = (_walk_step(value[end - 2], c), _next_step(value[end - 2], c)) if end > 1 else (None, 0)
        bend = BEND if step[0] != turn[0] else 0.0
        walk = min(walk + bend, best[end - 3] + WALK + bend if turn[0] else math.inf) if step[0] and end > 2 else math.inf
        sequence = min(sequence, best[end - 3]) if step[1] and step[1] == turn[1] else math.inf
        turn = step
        cost = min(cost, walk + STEP, sequence + SEQUENCE + STEP)
        for unit in range(1, UNIT + 1):
            had, least = again[unit][-unit], 3 if unit == 1 else 2
            now = math.inf
            if end >= 2 * unit and value[end - unit : end] == value[end - 2 * unit : end - unit]:
                whole_ = end >= least * unit and value[end - least * unit : end - unit] == value[end - unit : end] * (least - 1)
                now = min(had, best[end - least * unit] if whole_ else math.inf)
                if now + STEP < cost:
                    inner = brute_cost(c) if unit == 1 else guess_cost(value[end - unit : end], path)
                    cost = min(cost, now + inner + REPEAT + STEP)
            again[unit].append(now)
            del again[unit][0]
        best[end] = cost
        if enough < math.inf:
            live = min(*best[max(0, end - LONGEST) : end + 1], walk, sequence, *map(min, again))
            if live >= enough:
                return live
    return best[n]


def _mixed(value: str) -> bool:
    """Whether a piece of the value (between hyphens and the like) mixes classes of characters, as words of prose do not."""
    return any(
        SIGN.search(x) or (any(c.isdigit() for c in x) and any(c.isalpha() for c in x)) or sum(c.isdigit() for c in x) >= LEAST_CHARS
        or len(TURN.findall(x)) >= 2 for x in PIECE.split(value)
    )


def spans(text: str, path: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind as listed.  path: the dictionary's vocabulary file."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".!?:":
            b -= 1
        told = ":" in text[m.start() : m.start(1)] or "=" in text[m.start() : m.start(1)]
        if b - a >= LEAST_CHARS and (told or _mixed(text[a:b])) and guess_cost(text[a:b], path, LEAST_COST) >= LEAST_COST:
            found.append(("guess", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, dictionary: str | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans.  dictionary: path of a tokenizer's vocabulary file."""
    bounded_batches(docs.sparkSession, 1000)
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                found = spans(t, dictionary)
                n = [sum(k == kind for k, _, _ in found) for kind in KINDS]
                rows.append((i, *n, hashlib.sha256(_joined([x for x in found if x[0] != "guess"]).encode()).hexdigest(), _joined(found)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, FOUND)


def mask(text: str, path: str | None = None, filler: str = "[{}]") -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in spans(text, path):
        if a >= at:
            out += [text[at:a], filler.format(kind)]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, dictionary: str | None = None, column: str = "text") -> DataFrame:
    """docs with all spans of ``column`` masked; nulls stay null, other columns stay as they are."""
    bounded_batches(docs.sparkSession, 1000)
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masked = pa.array([None if t is None else mask(t, dictionary) for t in b.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == place else b.column(i) for i in range(b.num_columns)], [f"c{i}" for i in range(b.num_columns)])

    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)
