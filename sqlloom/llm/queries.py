"""The registered queries of the text operators, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_digests
from .chat_format import chat_digests
from .common import crc_fold, table
from .fill_in_middle import middle_digests
from .language_id import fit_languages, predict_languages
from .media import media_digests
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .ngram_lm import score_texts
from .quality_classifier import fit_quality, score_quality
from .quality_rules import quality_rules
from .secret_scans import find_secrets
from .token_counts import count_tokens
from .vector_codes import vector_codes

#: Conversation -7 of the contract: control strings inside both texts.
TRICKY = [(-7, t, role, "\\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def quality_model(spark: SparkSession, sf_dir: str) -> dict | None:
    """Learned from the labelled rows outside the held-out fold."""
    return fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(crc_fold("doc_id", 3) != 1))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.select("doc_id", "text", "lang").filter(crc_fold("doc_id", 4) != 2))
    return predict_languages(docs, model).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(rows.unionByName(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold("doc_id", 5) != 1).alias("train"))
    return score_texts(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_quality_classifier, op3_language_id, op4_chat_formatting, op5_near_dedup, op6_secret_scans,
    op7_media_columns, op8_mixing_sources, op9_byte_bpe, op10_quality_rules, op11_fill_in_middle, op12_vector_codes,
    op13_lm_scoring,
)}


def _assigned(k: int, book: str) -> str:
    return f"""
        d{k} AS (
            SELECT x.row, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {book} c ON c.part = x.part AND c.j = x.j GROUP BY ALL),
        a{k} AS (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY ALL)"""


def _moved(k: int, book: str) -> str:
    return f"""
        m{k} AS (
            SELECT x.part, a.entry, x.j, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} a ON a.row = x.row AND a.part = x.part GROUP BY ALL),
        b{k} AS (
            SELECT c.part, c.entry, c.j, CASE WHEN m.n IS NULL THEN c.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
            FROM {book} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry AND m.j = c.j)"""


_VECTOR_CODES = f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, embedding, label, len(embedding) // 16 AS width FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        x AS (
            SELECT row, (i - 1) // width AS part, (i - 1) % width AS j, floor(256 * embedding[i]::DOUBLE)::BIGINT AS v
            FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
        b0 AS (SELECT part, row - 1 AS entry, j, v FROM x WHERE row <= 64),
        {_assigned(1, 'b0')}, {_moved(1, 'b0')}, {_assigned(2, 'b1')}, {_moved(2, 'b1')}, {_assigned(3, 'b2')},
        coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY row),
        digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (row), digest"""


ORACLE_SQL = {
    "op4_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
            sum(14 + length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c'))
                + length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')))::BIGINT AS formatted_chars,
            greatest(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END), 1)::BIGINT AS n_examples
        FROM c GROUP BY conv_id""",
    "op11_fill_in_middle": r"""
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
        drawn AS (
            SELECT doc_id, t, length(t) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM hashed),
        cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn),
        parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM parts""",
    "op12_vector_codes": _VECTOR_CODES,
}
