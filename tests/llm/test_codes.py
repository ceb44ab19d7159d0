"""Fill-in-middle, vector codes and language-model scores."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlloom.llm import ngram_lm
from sqlloom.llm.elias_fano import EliasFano, Successors, U, Words, mapped, quantised
from sqlloom.llm.fill_in_middle import fill_in_middle, middle_digests, restore
from sqlloom.llm.ngram_lm import score_texts
from sqlloom.llm.queries import ORACLE_SQL, QUERIES
from sqlloom.llm.vector_codes import codebooks_digest, encode_vectors, vector_codes


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def middle_by_force(i, t):
    t = t or ""
    h = [int(sha("1:" + ("" if i is None else str(i)))[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(t), "plain", None, None, sha(t), sha(t)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return i, len(t), form, len(p), len(m), sha(out), sha(t)


ODD = ["\\", "\\b\\d\x1f\\", "\x1f\x1f", "a<P>b", "<S", "S>", "<", "x<M", "P>\n\r\n", "\U0001f600" * 40 + "é́", "\\\\d\x1fbd" * 30, "$1 \\1 $", "<S<S><M"]


def test_middles_of_odd_texts(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 * j + k, t * (1 + j % 3)) for j in range(6) for k, t in enumerate(ODD)], "doc_id long, text string"))
    want = sorted((middle_by_force(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sorted(map(tuple, middle_digests(docs).collect()), key=str) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert middle_digests(no_docs).count() == 0


@pytest.mark.parametrize(("unit", "pattern"), [("word", r"\S+\s*|\s+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_middles_of_words_and_lines(spark, odd_docs, unit, pattern):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(k, t + " and\nmore " + t) for k, t in enumerate(ODD)], "doc_id long, text string"))
    for r in fill_in_middle(docs, unit, plain=0, spm=50).withColumn("back", restore(F.col("output"), F.col("form"))).collect():
        assert r["back"] == r["text"]
        units = re.findall(pattern, r["text"], re.A)
        assert "".join(units) == r["text"] and r["n"] == len(units)
        if r["form"] != "plain":
            h = [int(sha("1:" + ("" if r["doc_id"] is None else str(r["doc_id"])))[8 * k : 8 * k + 8], 16) % (len(units) + 1) for k in range(2)]
            assert r["prefix"] == "".join(units[: min(h)]) and r["suffix"] == "".join(units[max(h) :])


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_vector_codes"])
def test_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def codes_by_force(rows, parts, entries, rounds):
    """rows (id, vector, label) of one length."""
    x = [[[int(math.floor(256 * c)) for c in v][k * len(v) // parts : (k + 1) * len(v) // parts] for k in range(parts)] for _, v, _ in rows]
    order = sorted((i, v, k) for k, (i, v, _) in enumerate(rows) if i is not None)
    first = list({i: k for i, _, k in reversed(order)}.items())[::-1]
    start = [k for _, k in sorted(first)[:entries]]
    books = [[list(x[k][p]) for k in start] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in x:
                own.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in x]
    error = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for e, (_, _, label) in zip(error, rows, strict=True):
        total[label] += e
    digest = sha(",".join(str(c) for b in books for e in b for c in e))
    return [(i, "".join(f"{e:02x}" for _, e in f), e, total[label], digest) for (i, _, label), f, e in zip(rows, found, error, strict=True)]


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_vector_codes_by_force(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(int(i), np.round(rng.normal(0, 0.05 if i % 3 else 0.3, 8), 2).tolist(), (None, "a", "b")[i % 3]) for i in range(300)]
    rows += [rows[7], (7, [0.0] * 8, "c"), (None, [0.1] * 8, None)] + [(1000 + i, [0.125] * 8, "same") for i in range(50)]
    bad = [(-5, None, "a"), (-4, [0.1] * 7 + [None], "a"), (-3, [float("nan")] * 8, "b"), (-2, [float("inf")] + [0.0] * 7, "b"), (500, [0.5] * 6, "a"), (-1, [], "a")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label string").withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).repartition(3)
    got = vector_codes(df, parts=4, entries=16, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(codes_by_force(rows, 4, 16, rounds), key=str)


def test_vector_codes_of_few_and_no_rows(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    rows = [(3, [1.0, 2.0, 3.0], 1), (2, [-1.5, 0.25, 1e9], None)]
    codes, books = encode_vectors(spark.createDataFrame(rows, ddl), parts=2)
    # padded to two parts of two, and the large component counts as the largest
    assert books.tolist() == [[[-384, 64], [256, 512]], [[1 << 24, 0], [768, 0]]]
    assert sorted(map(tuple, codes.collect())) == [(2, None, "0000", 0), (3, 1, "0101", 0)]
    for none in ([], [(1, None, 1)], [(None, [1.0], 1)]):
        assert vector_codes(spark.createDataFrame(none, ddl)).count() == 0
    assert codebooks_digest(np.array([[[-1, 2]], [[3, 4]]])) == sha("-1,2,3,4")


def test_only_violated_parts_are_rescanned(spark, monkeypatch):
    from sqlloom.llm.vector_codes import Heaps, drifts, nearest, rescan, violated

    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (2, 8, 4))
    x = (centres[:, rng.integers(0, 8, 2000)].transpose(1, 0, 2) + rng.integers(-200, 200, (2000, 2, 4))).astype(np.int64)
    books, account, heaps, assigned = centres.astype(np.int64), np.zeros((2, 8)), Heaps(16), np.full((2000, 2), -1)
    rescan(x, books, account, assigned, heaps, {p: np.arange(2000) for p in range(2)})
    scanned = 0
    for _ in range(4):
        new = books + rng.integers(-6, 7, books.shape)
        account, books = account + drifts(books, new), new
        popped = violated(heaps, account, 1e-6)
        scanned += sum(map(len, popped.values()))
        rescan(x, books, account, assigned, heaps, popped)
        for p in range(2):
            assert (assigned[:, p] == nearest(x[:, p], books[p])[0]).all()
        assert sum(len(k) for k in heaps.keys) == 4000 and all((np.diff(k) >= 0).all() for k in heaps.keys)
    assert 0 < scanned < 4000


@pytest.mark.parametrize("top", [0, 1, 300, 1 << 20, (1 << 64) - 1])
def test_elias_fano(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        v = np.sort(rng.integers(0, top, n, np.uint64, endpoint=True))
        e = EliasFano.of(v)
        assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, top, 200, np.uint64, endpoint=True), np.array([0, top], U)])
        at, same = e.successor(q)
        assert (at == np.searchsorted(v, q, "left")).all() and (same == np.isin(q, v)).all()


def test_levels_in_mapped_bytes():
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 1 << 63, 500, np.uint64))
    level = Words(mapped(Words.build(words, np.arange(1, len(words) + 1))))
    assert (level.find(np.concatenate([words, words + U(1)]))[: len(words)] == np.arange(1, len(words) + 1)).all() and not level.find(words + U(1)).any()
    table = {int(c): np.unique(rng.integers(0, 1 << 40, rng.integers(1, 60), np.uint64)) for c in words[:100]}
    contexts, fans = np.array(sorted(table), U), np.array([len(table[c]) for c in sorted(table)])
    p = np.log10(rng.uniform(0.001, 1, fans.sum()))
    trie = Successors(mapped(Successors.build(contexts, fans, np.concatenate([table[c] for c in sorted(table)]), p)))
    got = trie.find(contexts, fans, np.concatenate([table[c] for c in sorted(table)]))
    assert got.all() and np.abs(trie.centres[got] - p).mean() < 0.01 and np.abs((trie.centres[got] - p).mean()) < 1e-3
    # a successor of another context, an unknown context
    other = np.roll(contexts, 1)
    shifted = trie.find(other, fans, np.concatenate([table[c] for c in sorted(table)]))
    assert not shifted[~np.concatenate([np.isin(table[int(c)], table[int(o)]) for c, o in zip(contexts, other, strict=True)])].any()
    assert not trie.find(words[200:300], np.ones(100, int), np.arange(100, dtype=U)).any()
    codes, centres = quantised(np.array([-1.0, -2.0, -1.0]))
    assert codes.tolist() == [2, 1, 2] and centres[1:3].tolist() == [-2.0, -1.0]


def scores_by_force(rows, mu=ngram_lm.MU):
    """rows (id, text, train)."""
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t, _ in rows]
    c, pairs = Counter(), Counter()
    for ws, (_, _, train) in zip(tokens, rows, strict=True):
        if train:
            c.update(ws)
            pairs.update(zip([None, *ws], ws, strict=False))
    n, v = sum(c.values()), len(c)
    out = []
    for ws, (i, _, train) in zip(tokens, rows, strict=True):
        one = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
        base = sum(math.log10(one(w)) for w in ws)
        score = sum(math.log10((pairs[u, w] + mu * one(w)) / (c[u] + mu)) for u, w in zip([None, *ws], ws, strict=False))
        out.append((i, bool(train), len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out


def alike(got, want, slip):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= 1e-9 * abs(w[6]) + slip * w[2] for g, w in zip(got, want, strict=True))


def test_scores_by_force(spark, sf_dir, odd_docs, no_docs, monkeypatch, tmp_path):
    # the tasks are forked with these: several blocks, several shards, split contexts
    docs = odd_docs.select("doc_id", "text", F.when(F.col("doc_id") == 6, None).otherwise(F.col("doc_id") % 5 != 1).alias("train"), F.lit(1).alias("n_tokens"))
    rows = [(r["doc_id"], r["text"], r["train"]) for r in docs.collect()]
    alike(score_texts(docs).collect(), scores_by_force(rows), 1e-6)
    assert score_texts(no_docs.withColumn("train", F.lit(True))).count() == 0
    nothing = score_texts(docs.withColumn("train", F.lit(False))).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == r["train_tokens"] == 0 for r in nothing)
    for size, value in (("WORD_BYTES", 100_000), ("PAIR_BYTES", 50_000)):
        monkeypatch.setattr(ngram_lm, size, value)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 5 != 1).alias("train"))
    rows = [tuple(r) for r in docs.collect()]
    model = os.path.join("file://" + str(tmp_path), "model")
    want = scores_by_force(rows)
    first = score_texts(docs, model_path=model).collect()
    alike(first, want, 0.01)
    # quantising errs by little a text, and without a bias
    errors = [g["score"] - w[6] for g, w in zip(sorted(first), sorted(want), strict=True)]
    assert abs(sum(errors)) < 1e-3 * sum(w[2] for w in want)
    # the levels answer for other documents, which teach them nothing
    held = docs.filter("doc_id % 5 = 1").withColumn("train", F.lit(True))
    by_id = {r["doc_id"]: r for r in first}
    for r in score_texts(held, model_path=model).collect():
        assert (r["n_known"], r["train_tokens"]) == (by_id[r["doc_id"]]["n_known"], by_id[r["doc_id"]]["train_tokens"])
        assert r["score"] == pytest.approx(by_id[r["doc_id"]]["score"]) and r["base_score"] == pytest.approx(by_id[r["doc_id"]]["base_score"])
    held_out = [g for g in first if not g["train"]]
    assert sum(g["score"] for g in held_out) > 0.97 * sum(g["base_score"] for g in held_out)


def test_pairs_and_blocks_are_split():
    """A context's successors over several shards, a text list over several blocks: shares add up to the whole."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema  # noqa: F401

    words = np.sort(np.unique(np.random.default_rng(2).integers(0, 1 << 63, 400, np.uint64)))
    tokens = np.random.default_rng(3).integers(0, len(words), 5000)
    tokens[::2] = 0  # a word of half the tokens
    block = pa.table({"block": [0], "words": [ngram_lm.pack(ngram_lm.gaps(words))], "tokens": [ngram_lm.pack(tokens.astype(np.uint32))], "lengths": [ngram_lm.pack(np.array([5000], np.uint32))], "train": [ngram_lm.pack(np.array([1], np.uint8))]})
    counts = np.full(len(words), 5, U)
    counts[0] = 64 * ngram_lm.SPLIT
    answers = pa.table({"level": [1], "shard": [0], "answer": [ngram_lm.pack(counts)]})
    p = ngram_lm.pairs_of(block, answers, 16)
    sizes = np.diff(p["edges"])
    assert sizes.sum() == len(p["asked"]) == p["n"] and sizes.max() < 2 * sizes.mean()
    for a, b in zip(p["edges"], p["edges"][1:]):
        assert (np.diff(p["u"][a:b]) >= 0).all()
