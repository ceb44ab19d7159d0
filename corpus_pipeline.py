"""From raw documents to token ids: quality, near-duplicates, secrets, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents.

Defined results, of every stage: null texts count as empty; repeated rows stay
rows of their own but where a stage chooses among them (near-duplicates, mix);
an empty table gives an empty table; further columns are carried along unchanged,
whatever their names; very long texts are handled whole.  Ties are settled by ids
and contents, so reruns agree.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.llm.byte_bpe import bpe_digests
from sqlloom.llm.common import crc_fold, shared_dir, table, written
from sqlloom.llm.mixing import apply_mix
from sqlloom.llm.near_dedup import keep_one_of_each
from sqlloom.llm.quality_classifier import fit_quality, keep_good
from sqlloom.llm.secret_scans import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rates good (a score of exactly 0.5 is good, as are all without a model);
    labels of the held-out fold are never learned from."""
    labels = table(spark, sf_dir, "labels").filter(crc_fold("doc_id", 3) != 1)
    return keep_good(docs, fit_quality(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; rows without an id stay."""
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked; n_chars follows the text, null texts stay null."""
    masked = mask_secrets(docs, public_tokenizers.path("word_bpe_49k.json"))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0 to 3 times) as its source's target weight asks for; a null source is a source."""
    return apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes, ids; one row for each copy."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("byte-level bpe", encoding),
]

#: No stage but the mix could be put in SQL; tests/llm/test_groups.py compares run() with all five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/stage{k}")
    return docs
