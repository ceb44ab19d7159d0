"""Language identification by nearest centroids.

Texts become TF-IDF vectors of hashed n-grams of 1 to 3 characters (lower
case, everything but letters one blank), of unit length.  Each language has several
centroids from spherical k-means; a text goes to the language of the centroid
with the highest cosine.  A text whose best cosine is below what 99.5 % of
its language's training texts reach, less a margin, is rejected.

Fitting uses a bounded sample, ``per_lang`` rows of each language, first by a
hash of their ids.  Prediction covers whole texts of all rows.

Defined results: ``und`` with score 0 for null texts and texts without a
letter, and for all texts where nothing could be learned; repeated rows and
ids each give a row; an empty table gives an empty table; other columns are
ignored.  Rows are independent: prediction shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

DIMS = 4096
CENTROIDS, ROUNDS, SHARPNESS, MARGIN = 3, 12, 24.0, 0.1
#: Odd multipliers of the hash, by position in the n-gram.
MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text; long texts go piece by piece, with two characters of overlap."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    c = np.where(_letter_table()[c], c, np.uint32(32))
    c = c[(c != 32) | (np.concatenate([[np.uint32(0)], c[:-1]]) != 32)]
    total = np.zeros(DIMS)
    for at in range(0, len(c), 500_000):
        p = c[max(0, at - 2) : at + 500_000]
        skip = at - max(0, at - 2)
        h = (p + np.uint32(1)) * MULTIPLIERS[0]
        one = h[skip:]
        two = (h[:-1] ^ p[1:]) * MULTIPLIERS[1] if len(p) > 1 else h[:0]
        three = (two[:-1] ^ p[2:]) * MULTIPLIERS[2] if len(p) > 2 else h[:0]
        total += np.bincount(np.concatenate([one, two[max(0, skip - 1) :], three[max(0, skip - 2) :]]) >> np.uint32(20), minlength=DIMS)
    return total


def unit(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counted) * idf
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.maximum(n, 1e-12)


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the mean and the texts farthest from what is chosen."""
    start = [v.mean(axis=0)]
    while len(start) < min(k, len(v)):
        near = np.max(v @ np.array([s / max(np.linalg.norm(s), 1e-12) for s in start]).T, axis=1)
        start.append(v[int(np.argmin(near))])
    c = np.array(start)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(v @ c.T, axis=1)
        c = np.array([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit_languages(known: DataFrame, per_lang: int = 200, centroids: int = CENTROIDS) -> dict | None:
    """Centroids from rows (doc_id, text, lang); rows without text, letter or lang teach nothing."""
    bounded_batches(known.sparkSession)
    rows = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return None
    # a hash of the id picks a few more than asked for of each language; the rest is cut below
    share = F.lit(1.0)
    for lang, k in n.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.5 * per_lang / k)).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, lang, t in zip(b["doc_id"].to_pylist(), b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                if has_letter(t):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([lang]), pa.array([counts(t).astype(np.float32).tobytes()], pa.binary())], ["doc_id", "lang", "v"])

    got = rows.filter(u < share).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, lang string, v binary").toPandas()
    got = got.sort_values(["lang", "doc_id"], kind="stable").groupby("lang").head(2 * per_lang)
    if got.empty:
        return None
    x = np.array([np.frombuffer(v, np.float32) for v in got["v"]], float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    v, lang = unit(x, idf), got["lang"].to_numpy()
    names = sorted(set(lang))
    groups = [_clusters(v[lang == s], centroids) for s in names]
    reach = [float(np.quantile((v[lang == s] @ g.T).max(axis=1), 0.005)) - MARGIN for s, g in zip(names, groups, strict=True)]
    return {"names": names, "idf": idf, "centroids": np.concatenate(groups), "starts": np.cumsum([0, *map(len, groups)])[:-1], "reach": np.array(reach)}


def predict_languages(docs: DataFrame, model: dict | None, reject: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, cosine, rejected.  reject: rejected texts become ``und``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, cosine, rejected = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            texts = b["text"].to_pylist()
            fit = [i for i, t in enumerate(texts) if t and model and has_letter(t)]
            if fit:
                v = unit(np.array([counts(texts[i]) for i in fit]), model["idf"])
                cos = np.maximum.reduceat(v @ model["centroids"].T, model["starts"], axis=1)
                best = np.argmax(cos, axis=1)
                top = cos[np.arange(len(fit)), best]
                p = 1 / np.exp(SHARPNESS * (cos - top[:, None])).sum(axis=1)
                far = top < model["reach"][best]
                score[fit], cosine[fit], rejected[fit] = p, top, far
                for i, k, r in zip(fit, best.tolist(), far.tolist(), strict=True):
                    lang[i] = "und" if reject and r else model["names"][k]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lang), pa.array(score), pa.array(cosine), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")
