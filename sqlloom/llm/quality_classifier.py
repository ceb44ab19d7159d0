"""Quality classifier by compression.

Two zstandard dictionaries are built from blocks of labelled good and bad
texts.  A text is compressed block by block with both.  One number tells how
much better the good dictionary does, normalised by length:

    (bytes with the bad one - bytes with the good one + OFFSET) / (bytes of the text + PRIOR)

Logistic regression of the label on this number alone, over labelled rows
that did not go into the dictionaries, calibrates it to a probability.
OFFSET and PRIOR only steady very short texts.

Fitting uses a bounded sample of labelled rows: ``per_class`` rows of each
label, first by a hash of their ids, of which half give at most
``blocks_per_text`` blocks each to a dictionary and half calibrate.  Scoring
covers all blocks of every text, so a very long text costs time in proportion.

Defined results: a null text counts as empty; an empty text has score by
calibration like any other; a score of exactly 0.5 counts as good (predicted
1, kept); without labelled rows of both classes every score is 0.5; repeated
rows and ids each give a row, with equal scores for equal texts; an empty
table gives an empty table; other columns are ignored when scoring and kept
as they are when filtering, whatever their names.  Rows are independent:
scoring shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole

#: Characters of a block for a dictionary, bytes of a block that is compressed by itself, size of a dictionary, zstandard's level.
SAMPLE, BLOCK, DICT_BYTES, LEVEL = 256, 1024, 65_536, 3
OFFSET, PRIOR = 4, 64


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """The normalised difference of compressed sizes of each text."""
    sizes = lambda c, t: sum(len(c.compress(x)) for x in _blocks(t))
    return np.array([(sizes(bad, t) - sizes(good, t) + OFFSET) / (len(t) + PRIOR) for t in texts], float)


def probability(d: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + weights[1] * d, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps with a small ridge, on columns of unit spread."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, blocks_per_text: int = 8) -> dict | None:
    """Dictionaries and calibration from labelled rows (doc_id, quality).  docs: doc_id, text."""
    bounded_batches(docs.sparkSession)
    order = F.xxhash64(F.lit("quality"), "doc_id")
    known = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("_y"))
    # at most 2 * per_class ids: small enough for every executor whatever the corpus
    picked = known.filter("_y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.filter("_y = 0").orderBy(order, "doc_id").limit(per_class))
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(picked), "doc_id")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    cut = F.transform(F.sequence(F.lit(0), F.least(F.ceil(F.length("text") / SAMPLE) - 1, F.lit(blocks_per_text - 1)).cast("int")), lambda i: F.substring("text", (i * F.greatest(F.lit(SAMPLE), F.floor(F.length("text") / blocks_per_text)) + 1).cast("int"), F.lit(SAMPLE)))
    parts = rows.filter((half == 0) & (F.length("text") > 0)).select("_y", "doc_id", cut.alias("blocks")).toPandas().sort_values("doc_id", kind="stable")
    trained = {}
    for y in (0, 1):
        samples = [b.encode()[:SAMPLE] for bs in parts.loc[parts["_y"] == y, "blocks"] for b in bs]
        if not samples:
            return None
        try:
            trained[y] = zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: they serve as they are
            trained[y] = b"".join(samples)[-DICT_BYTES:]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = _compressor(trained[1]), _compressor(trained[0])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["_y"], pa.array(differences([t.encode() for t in b["text"].to_pylist()], good, bad), pa.float64())], ["y", "d"])

    rest = rows.filter(half == 1).select("_y", "text").mapInArrow(measure, "y int, d double").toPandas()
    if rest["y"].nunique() < 2:
        return None
    rest = rest.sort_values(["y", "d"], kind="stable")
    return {"good": trained[1], "bad": trained[0], "weights": fit_logistic(np.column_stack([np.ones(len(rest)), rest["d"].to_numpy()]), rest["y"].to_numpy(float))}


def score_quality(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, and score (0 to 1): how likely a text is good."""
    bounded_batches(docs.sparkSession)
    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), whole().alias("t"))
    schema = ", ".join([*(f"k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            good, bad = _compressor(model["good"]), _compressor(model["bad"])
        for b in batches:
            if model:
                p = probability(differences([t.encode() for t in b["t"].to_pylist()], good, bad), model["weights"])
            else:
                p = np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(p, pa.float64())], [*(f"k{i}" for i in range(len(keep))), "score"])

    return inner.mapInArrow(run, schema).toDF(*keep, "score")


def keep_good(docs: DataFrame, model: dict | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least ``least``; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    place, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            good, bad = _compressor(model["good"]), _compressor(model["bad"])
        for b in batches:
            if model:
                p = probability(differences([(t or "").encode() for t in b.column(place).to_pylist()], good, bad), model["weights"])
                b = b.filter(pa.array(p >= least, pa.bool_()))
            yield b

    inner = docs.toDF(*names)
    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)
