"""Operators that bring rows together: chat formatting, near-duplicates, mixing, the pipeline."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest

from sqlloom.llm import mixing, near_dedup
from sqlloom.llm.chat_format import chat_digests, expand_examples, format_conversations, unescape
from sqlloom.llm.mixing import WEIGHTS, mix_sources, source_targets
from sqlloom.llm.near_dedup import near_duplicates
from sqlloom.llm.queries import ORACLE_SQL, QUERIES

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = sorted(db.sql(ORACLE_SQL["op4_chat_formatting"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in QUERIES["op4_chat_formatting"](spark, sf_dir).collect()), key=str) == want


def test_chat_odd_rows(spark):
    rows = [
        (1, 0, "user", "a</turn>\n### assistant: b", "x"), (1, 1, "assistant", "\\b\\h#<", None), (1, 1, "assistant", "\\b\\h#<", None), (1, 2, "we: ird\\", None, None),
        (2, None, None, None, None), (3, 0, "assistant", "", None), (None, 5, "user", "é\U0001f600" * 50_000, None), (4, 0, "user", "only", None),
    ]
    got = {r["conv_id"]: r for r in chat_digests(spark.createDataFrame(rows, TURNS)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_digests(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_expansion(spark):
    rows = [(1, 0, "user", "q1", ""), (1, 1, "assistant", "a1", ""), (1, 2, "user", "q2", ""), (1, 3, "assistant", "a#2", ""), (1, 4, "user", "bye", "")]
    e = expand_examples(format_conversations(spark.createDataFrame(rows, TURNS))).orderBy("example").collect()
    assert [unescape_text(spark, r["target"]) for r in e] == ["a1", "a#2"]
    assert e[0]["prompt"] == "### user: q1</turn>\n### assistant: " and e[0]["tail"] is None
    assert e[1]["prompt"] == "### user: q1</turn>\n### assistant: a1</turn>\n### user: q2</turn>\n### assistant: " and e[1]["tail"] == "</turn>\n### user: bye</turn>\n"


def test_every_prompt_and_target(spark, sf_dir):
    """All examples of all conversations: the turns before, escaped, then the reply."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    by = {}
    for r in rows.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    esc = lambda t: t.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    want = []
    for conv, turns in by.items():
        said, n = "", 0
        for _, role, text in sorted(turns):
            head = f"### {esc(role).replace(':', chr(92) + 'c')}: "
            if role == "assistant":
                want.append((conv, n, said + head, esc(text)))
                n += 1
            said += head + esc(text) + "</turn>\n"
        if not n:
            want.append((conv, 0, "", ""))
    got = expand_examples(format_conversations(rows)).select("conv_id", "example", "prompt", "target").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def unescape_text(spark, x):
    return spark.createDataFrame([(x,)], "x string").select(unescape("x")).first()[0]


def sets_by_force(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def components_by_force(rows):
    s, parent = sets_by_force(rows), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return sorted(((i, len(x), None if i is None else find(i)) for (i, _), x in zip(rows, s, strict=True)), key=str)


def family(seed, n, words=60, edits=2, far=0):
    """Edits of one base text, and ``far`` members with so many edits that they drop off."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    out = []
    for k in range(n):
        t = list(base)
        for _ in range(edits if k >= far else 4 * edits):
            t[r.randrange(words)] = f"x{r.randrange(10_000)}"
        out.append(" ".join(t))
    return [" ".join(base), *out]


def test_near_duplicates_against_brute_force(spark, monkeypatch, odd_docs):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # so that buckets are cut into blocks
    texts = [t for k in range(12) for t in family(k, 25, 60 + 10 * k, 1 + k % 3, far=8)] + ["a b c", "A B C", "a b", "", None, "One two THREE four five six", "one two three four five six"]
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == components_by_force(rows)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = near_duplicates(odd_docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components_by_force(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)


def test_near_duplicates_of_nothing(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert near_dedup.keep_one_of_each(no_docs).count() == 0


def test_one_id_with_several_texts(spark, odd_docs):
    """Texts of one id are one document: what is linked with any of them is linked with it, and with what is linked with the others."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (3, b + " more"), (4, a + " more"), (5, "c d"), (6, a), (7, None), (7, b), (2, "x y"), (2, "c d")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components_by_force(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 3: 1, 4: 1, 6: 1, 7: 1, 2: 2, 5: 2}
    kept = near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (2, "c d")]
    odd = near_dedup.keep_one_of_each(odd_docs)
    assert odd.columns == odd_docs.columns
    assert sorted((str(r["doc_id"]) for r in odd.collect())) == ["1", "2", "3", "4", "5", "6", "8", "9", "None"]


def test_near_duplicates_of_documents_against_brute_force(spark):
    """All of the 1,000-document table: no component differs from that of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components_by_force(rows)


def test_sketch_merges_and_estimates():
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 1 << 63, 4000).astype(np.uint64) for _ in range(2))
    assert (near_dedup.sketch(np.concatenate([a, b])) == np.maximum(near_dedup.sketch(a), near_dedup.sketch(b))).all()
    c = np.concatenate([a[:3700], b[:300]])  # similarity 0.86
    x, y = near_dedup.sketch(a), near_dedup.sketch(c)
    link = near_dedup.may_link(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([4000.0]), np.array([4000.0]))
    z = near_dedup.sketch(np.concatenate([a[:2400], b[:1600]]))
    far = near_dedup.may_link(np.array([(x > z).sum()]), np.array([(x < z).sum()]), np.array([4000.0]), np.array([4000.0]))
    assert link[0] and not far[0]


def test_targets_fill_by_weight():
    t = source_targets([("a", 100), ("b", 1000), ("c", 10), (None, 500)])
    assert sum(t.values()) == pytest.approx(1610) and all(t[s] <= 3 * n + 1e-9 for s, n in [("a", 100), ("b", 1000), ("c", 10), (None, 500)])
    assert t["a"] == 300 and t["c"] == 30 and t["b"] / 2 == pytest.approx(t[None] / 5) or t[None] == pytest.approx(1280 * 5 / 7)
    assert source_targets([]) == {} and source_targets([("a", 0)]) == {"a": 0.0} and WEIGHTS == (5, 2, 1)


def test_mixing(spark, odd_docs, no_docs):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 60))), f"s{min(r.randrange(12), 6)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs, chunk_rows=100, fan_in=4).toPandas()
    again = mix_sources(docs.repartition(7), chunk_rows=100, fan_in=4).toPandas()
    assert dict(zip(got["doc_id"], got["taken"], strict=True)) == dict(zip(again["doc_id"], again["taken"], strict=True))
    assert len(got) == 3000 and (got["taken"] <= 3 * got["size"]).all() and got["target"].groupby(got["source"]).first().sum() == pytest.approx(got["size"].sum())
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1  # some have one word only
        rate = g["target"].iloc[0] / g["source_size"].iloc[0]
        assert (~g["copies"].isin([int(rate), int(rate) + 1])).sum() <= 20
    odd = mix_sources(odd_docs)
    assert odd.count() == odd_docs.count() and odd.filter("size = 0 and taken <> 0").count() == 0 and odd.filter("taken > 3 * size").count() == 0
    assert mix_sources(no_docs).count() == 0


def test_mixing_of_few_documents_keeps_floor_and_ceiling(spark):
    """Sources of one to forty documents: copies are the whole numbers around the expectation, words within the smallest document or the best choice of few."""
    r = random.Random(9)
    rows = [(100 * s + k, " ".join("w" * 1 for _ in range(r.randrange(1, 400))), f"s{s}") for s in range(12) for k in range((1, 2, 3, 4, 10, 40)[s % 6])]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source"):
        target, low = g["target"].iloc[0], math.floor(g["target"].iloc[0] / g["source_size"].iloc[0])
        assert g["copies"].isin([low, low + 1]).all()
        off = abs(g["taken"].sum() - target)
        if len(g) <= 10:
            best = min(abs(sum(c * n for c, n in zip(cs, g["size"], strict=True)) - target) for cs in itertools.product((low, low + 1), repeat=len(g)))
            assert off <= max(best, g["size"].min()) + 1e-6
        else:
            assert off <= g["size"].min()


def test_mixing_keeps_expectations(spark):
    """The mean of copies over many seeds is each document's expectation, for all sizes of documents."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join("w" for _ in range(r.randrange(1, 90))), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string").cache()
    total, n = collections.Counter(), 24
    for seed in range(n):
        rows = mix_sources(docs, seed=seed, chunk_rows=20, fan_in=2).collect()
        total.update({x["doc_id"]: x["copies"] for x in rows})
    want = {x["doc_id"]: x["target"] / x["source_size"] for x in rows}
    z = [(total[i] / n - want[i]) / max((want[i] % 1) * (1 - want[i] % 1) / n, 1e-9) ** 0.5 for i in want]
    assert max(map(abs, z)) < 4.5 and abs(sum(z) / len(z)) < 0.5
    large = [z[i] for i, x in enumerate(rows) if x["size"] > 60]
    assert abs(sum(large) / len(large)) < 1


def test_duels_keep_words_and_expectations():
    r = np.random.default_rng(2)
    p, size = r.random(9), r.integers(1, 50, 9)
    total, words = np.zeros(9), (p * size).sum()
    for _ in range(20_000):
        out, held, mass = mixing.duels(p, size, r.random(9))
        full = out.astype(float)
        if held >= 0:
            full[held] = mass
        assert abs((full * size).sum() - words) < 1e-6
        total += full
    assert np.abs(total / 20_000 - p).max() < 0.015
    for _ in range(200):
        sizes, up = r.integers(1, 30, 12).tolist(), r.integers(0, 2, 12).tolist()
        missing = float(r.integers(-25, 26))
        new = mixing.settle(sizes, up, missing)
        off = lambda c: abs(sum(s * (a - b) for s, a, b in zip(sizes, c, up, strict=True)) - missing)
        assert set(new) <= {0, 1} and off(new) <= min(abs(missing), max(min(map(off, itertools.product((0, 1), repeat=12))), min(sizes)))


def test_rows_of_one_id_are_spread_and_mixed(spark, odd_docs, no_docs):
    """Equal rows of one id, and of no id, reach several chunks and meet the target; apply_mix gives the counted copies."""
    rows = [(None, "a b c", "s", 1)] * 900 + [(7, "d e", "s", 2)] * 500 + [(i, "f g h i", "t", 3) for i in range(300)] + [(8, "", "s", 4), (9, None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix_sources(docs, chunk_rows=200, fan_in=2).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 4
    mixed = mixing.apply_mix(docs, chunk_rows=200, fan_in=2)
    assert mixed.columns == docs.columns
    count = lambda rows: sorted(collections.Counter(map(str, rows)).items())
    want = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.source) for r in got.itertuples() for _ in range(r.copies)]
    assert count((r["doc_id"], r["source"]) for r in mixed.collect()) == count(want)
    odd = mixing.apply_mix(odd_docs)
    assert odd.columns == odd_docs.columns and mixing.apply_mix(no_docs).count() == 0
    assert odd.filter("doc_id = 5").count() <= 3


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != p.STAGES[-1][0]:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] and seen[4] == seen[5] > 0
    assert docs.filter("n_tokens <> size(ids)").count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() on a small corpus with nulls, ties, exact and near copies and secrets, against all five stages spelt out for single rows."""
    import public_tokenizers as P
    import tiktoken
    import zstandard

    import corpus_pipeline as p
    from sqlloom.llm import quality_classifier as Q
    from sqlloom.llm.common import crc_fold
    from sqlloom.llm.secret_scans import spans

    r = random.Random(12)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(3, 8))) for _ in range(150)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    junk = lambda n: " ".join(f"{r.choice('#$%&')}{r.randrange(10**6)}|" for _ in range(n))
    texts = [junk(r.randrange(40, 90)) if i % 4 == 0 else prose(r.randrange(40, 160)) for i in range(120)]
    texts[50:53] = [texts[49]] * 3  # exact copies
    texts[54] = texts[53] + " tail"  # a near copy
    texts[57] += " DB_PASSWORD=Xk39fj2lQQ9z and AKIA" + "A1" * 9
    texts[58] += " the password is simple"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(200, None, None, None, None), (201, "", "en", "s0", 0)]
    rows += [(202, prose(70), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(120)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = p.run(spark, str(tmp_path)).collect()

    model = Q.fit_quality(docs, labels.filter(crc_fold("doc_id", 3) != 1))
    size = lambda part, which: len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(model[which]), write_content_size=False, write_dict_id=False).compress(part))

    def good(t):
        raw = (t or "").encode()
        gap = sum(size(raw[k : k + Q.BLOCK], "bad") - size(raw[k : k + Q.BLOCK], "good") for k in range(0, len(raw), Q.BLOCK))
        return model["weights"][0] + model["weights"][1] * (gap + Q.OFFSET) / (len(raw) + Q.PRIOR) >= 0

    kept = [x for x in rows if good(x[1])]
    assert {x[0] for x in kept} >= {i for i in range(120) if i % 4} and not {x[0] for x in kept} & {i for i in range(0, 120, 4) if i % 4 == 0 and i not in (52,)}
    component = {i: c for i, _, c in components_by_force([x[:2] for x in kept])}
    kept = [x for x in kept if component[x[0]] == x[0]]
    assert not {50, 51, 52, 54} & {x[0] for x in kept} and {49, 53} <= {x[0] for x in kept}

    def masked(t):
        for kind, a, b in sorted(spans(t, P.path("word_bpe_49k.json")), key=lambda x: -x[1]):
            t = t[:a] + "\0" * (b - a) + t[b:]
        return t

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    by_id = {x[0]: x for x in kept}
    seen = {}
    for row in got:
        x = by_id[row["doc_id"]]
        text = library.decode(row["ids"])
        clear = [piece for piece in re.split(r"\0+", masked(x[1] or "")) if piece]
        assert re.fullmatch(r"\[[a-z]+\]".join(map(re.escape, clear)) + r"(\[[a-z]+\])?", text) or text == (x[1] or "")
        assert row["ids"] == library.encode_ordinary(text) and row["n_tokens"] == len(row["ids"])
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert "Xk39" not in text and "AKIA" not in text
        seen[x[0]] = (seen.get(x[0], (0,))[0] + 1, text)
    # the mix: at most three times each, words near the targets of what came in
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = {i: count(seen[i][1] if i in seen else x[1]) for i, x in by_id.items()}
    sizes = {}
    for i, x in by_id.items():
        sizes[x[3]] = sizes.get(x[3], 0) + words[i]
    targets = source_targets(list(sizes.items()))
    assert max(n for n, _ in seen.values()) <= 3
    for s, goal in targets.items():
        took = sum(n * words[i] for i, (n, _) in seen.items() if by_id[i][3] == s)
        assert abs(took - goal) <= min(words[i] for i, x in by_id.items() if x[3] == s and words[i])


def test_stages_on_odd_and_no_rows(spark, odd_docs, no_docs):
    """Every stage on nulls, empty and very long texts, repeated rows and clashing names; all but the last keep the columns."""
    import corpus_pipeline as p

    for docs in (odd_docs, no_docs):
        n = docs.count()
        for name, stage in p.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            rows = out.collect()
            if name != p.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            if name == "secret scans" or name == p.STAGES[-1][0]:
                assert len(rows) == n, name
            assert len(rows) <= 3 * n and (n or not rows), name
