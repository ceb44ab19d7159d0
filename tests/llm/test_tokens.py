"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sqlloom.llm.byte_bpe import bpe_digests, codec, decode_ids, encode_texts
from sqlloom.llm.token_counts import count_tokens

WORD, MULTI = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "中", "1", "٣", "!", "#", " ", "　", "😀", "R", "'S", "\x1c", "\x85", "\x00", "<|endoftext|>", "ab"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n):
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(n)]


def test_boundaries_and_merges_as_the_library(library):
    c, t = codec(MULTI), [*texts(4000), "a" * 3000, "ab" * 2000, "!" * 500, " " * 300, ""]
    ids, at = c.encode(t)
    for x, i, j in zip(t, at, at[1:], strict=False):
        assert ids[i:j].tolist() == library.encode_ordinary(x), x
        assert c.decode(ids[i:j]) == x.encode()
        assert c.offsets(ids[i:j])[-1] == len(x.encode())


def test_bpe_query_on_odd_rows(spark, odd_docs, no_docs, library):
    rows = odd_docs.collect()
    want = sorted(((r["doc_id"], hashlib.sha256(",".join(map(str, library.encode_ordinary(r["text"] or ""))).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows), key=str)
    got = sorted(((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_digests(odd_docs, MULTI).collect()), key=str)
    assert got == want
    back = {(r["doc_id"], bytes(r["bytes"]).decode()) for r in decode_ids(encode_texts(odd_docs, MULTI), MULTI).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in rows}
    assert bpe_digests(no_docs, MULTI).count() == 0


@pytest.mark.parametrize("path", [WORD, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")])
def test_counts_as_the_library(spark, odd_docs, no_docs, path):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts(300))], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    if path.endswith(".json"):
        t = Tokenizer.from_file(path)
        n = [len(x.ids) for x in t.encode_batch([x for _, x in rows], add_special_tokens=False)]
    else:
        import sentencepiece

        n = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([x for _, x in rows])]
    want = sorted(((i, len(x.encode()), k, k > 2048) for (i, x), k in zip(rows, n, strict=True)), key=str)
    assert sorted((tuple(r) for r in count_tokens(docs, path).collect()), key=str) == want
    assert count_tokens(no_docs, path).count() == 0


def test_cache_is_used_and_appended(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    a = spark.createDataFrame([(1, "one two"), (2, "one  two"), (3, "three")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(a, WORD, cache).collect()} == {1: 2, 2: 2, 3: 1}
    assert spark.read.parquet(cache).count() == 2  # white space is normalised: two digests
    b = a.unionByName(spark.createDataFrame([(4, "three four")], "doc_id long, text string"))
    assert count_tokens(b, WORD, cache).count() == 4
    assert spark.read.parquet(cache).count() == 3
