"""Token counts through a digest cache.

A text's content digest (SHA-256 of its normalised form) and its tokenizer's
version digest (SHA-256 of the vocabulary file and the library's version) key
a Parquet cache of counts.  Each run joins the digests to the cache, encodes
one text for each digest that is missing, appends the counts, and joins the
cache back to the documents.

Normalising must not change a count: for vocabularies that drop white space,
runs of ASCII white space become one blank; for all others the text stays.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows and ids each give a row; an empty table gives an empty table; other
columns are ignored.  Texts travel as distinct digests only, partly
aggregated before the shuffle, so a text with very many copies moves once
for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, whole, written

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Words that one Python worker remembers before it starts afresh, and the longest it remembers.
MEMO_WORDS, MEMO_CHARS = 1_000_000, 64
_memo: dict[str, dict[str, int]] = {}


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    kind = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(Path(path).read_bytes() + kind.encode()).hexdigest()


def drops_white(path: str) -> bool:
    """Whether no token of the vocabulary can span or contain white space, so that words count by themselves.

    Such vocabularies turn white space into blanks, drop the blanks between matches, and add no prefix.
    """
    import json

    if not path.endswith(".json"):
        return False
    t = json.loads(Path(path).read_text())
    pre = (t.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = pre[0]
    blanks = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} for n in (t.get("normalizer") or {}).get("normalizers", []))
    return blanks and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and r"^\s" in split["pattern"].get("Regex", "") and not any(p.get("add_prefix_space") for p in pre)


def normalised(text: Column, by_word: bool) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if by_word else text


def _counter(path: str, by_word: bool):
    """A function from texts to counts; words are encoded once in a worker's life where they count by themselves."""
    if not path.endswith(".json"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    if not by_word:
        return encode

    def count(texts: list[str]) -> list[int]:
        memo = _memo.setdefault(path, {"": 0})
        split = [t.split(" ") for t in texts]
        new = list(set().union(*split).difference(memo))
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            memo[""] = 0
            new = list(set().union(*split).difference(memo))
        long = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, n in zip(part, encode(part), strict=True):
                (memo if len(w) <= MEMO_CHARS else long)[w] = n
        if long:
            look = lambda w: memo[w] if w in memo else long[w]
            return [sum(map(look, ws)) for ws in split]
        return [sum(map(memo.__getitem__, ws)) for ws in split]

    return count


def encode_misses(misses: DataFrame, path: str, by_word: bool, digest: str) -> DataFrame:
    """content_digest, tokenizer_digest, n_tokens for each row (content_digest, text)."""
    schema = pa.schema([("content_digest", pa.binary()), ("tokenizer_digest", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, by_word)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["content_digest"].cast(pa.binary()), pa.array([digest] * b.num_rows), pa.array(count(b["text"].to_pylist()), pa.int64())], schema=schema)

    return misses.mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, vocab_path: str, cache_path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.  cache_path: the cache, made where it is missing; by default one of this call's own."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark)
    cache_path = cache_path or f"{folder}/token-counts"
    digest, by_word = tokenizer_digest(vocab_path), drops_white(vocab_path)
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("append").parquet(cache_path)
    text = normalised(whole(), by_word)
    keyed = docs.select("doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"), text.alias("text"))
    keyed = keyed.withColumn("content_digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == digest).select("content_digest", "n_tokens")
    misses = keyed.groupBy("content_digest").agg(F.first("text").alias("text")).join(cache, "content_digest", "left_anti")
    written(encode_misses(misses, vocab_path, by_word, digest), cache_path, "append")
    # a run that was repeated may have appended a digest twice
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    # written first: a join right above the grouping would keep all copies of a text in one task, this one can be split
    cache = written(cache, f"{folder}/counts")
    return keyed.select("doc_id", "n_bytes", "content_digest").join(cache, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
