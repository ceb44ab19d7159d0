"""Operators that look at one row at a time: secrets, media, quality rules, language, quality."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sqlloom.llm import media, secret_scans
from sqlloom.llm.jpeg import luminance
from sqlloom.llm.language_id import fit_languages, predict_languages
from sqlloom.llm.quality_classifier import fit_quality, keep_good, score_quality
from sqlloom.llm.quality_rules import RULES, fit_rules, quality_rules
from sqlloom.llm.queries import QUERIES, ORACLE_SQL


WORD = public_tokenizers.path("word_bpe_49k.json")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rules_by_force(t):
    t = t or ""
    w, at, covered = words(t), {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rated = quality_rules(docs).collect()
    got = [(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in rated]
    assert sorted(got, key=str) == sorted(((r["doc_id"], rules_by_force(r["text"])) for r in docs.collect()), key=str)
    posterior, votes = {}, {}
    for r in rated:
        v = tuple(r[f"v_{x}"] for x in RULES)
        posterior[v], votes[v] = r["posterior"], votes.get(v, 0) + 1
    model = fit_rules(list(votes.items()))
    for v, p in posterior.items():
        good, bad = (np.prod([share, *(model[k][x][y] for x, y in zip(RULES, v, strict=True))]) for k, share in (("good", model["prior"]), ("bad", 1 - model["prior"])))
        assert p == pytest.approx(good / (good + bad), abs=1e-9)
    assert quality_rules(odd_docs).filter("base_failed and kept").count() == 0
    assert quality_rules(no_docs).count() == 0


def test_quality_rules_keep_clean_and_drop_junk(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    y = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    r = quality_rules(d).join(y, "doc_id").filter("not base_failed").groupBy("quality").agg({"*": "count"}, ).toPandas()
    k = quality_rules(d).join(y, "doc_id").filter("not base_failed and kept").groupBy("quality").count().toPandas().set_index("quality")["count"]
    n = r.set_index("quality").iloc[:, 0]
    assert k.get(1, 0) >= 0.98 * n[1] and k.get(0, 0) <= 0.05 * n[0]


def test_rules_fit_as_numpy_does():
    """The same expectation-maximisation over single rows with numpy; made votes of known accuracies are found again."""
    from sqlloom.llm import quality_rules as Q

    rng, n = np.random.default_rng(8), 20_000
    good = rng.random(n) < 0.7
    truth = {True: np.linspace(0.01, 0.08, len(RULES)), False: np.linspace(0.45, 0.7, len(RULES))}
    x = np.array([[-1 if u < truth[g][j] else 0 if u < truth[g][j] + 0.1 else 1 for j, u in enumerate(row)] for g, row in zip(good.tolist(), rng.random((n, len(RULES))).tolist(), strict=True)])
    rows, count = np.unique(x, axis=0, return_counts=True)
    model = Q.fit_rules([(tuple(r), int(c)) for r, c in zip(rows.tolist(), count, strict=True)])
    t = np.array([[[Q.START[k][v] for v in (-1, 0, 1)] for _ in RULES] for k in ("good", "bad")])
    start, prior, held = t.copy(), Q.PRIOR, Q.BELIEF * n + 1
    one_hot = np.eye(3)[x + 1]
    for _ in range(500):
        like = np.einsum("nrv,krv->nk", one_hot, np.log(t)) + np.log([prior, 1 - prior])
        p = np.exp(like - like.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = (np.einsum("nk,nrv->krv", p, one_hot) + held * start) / (p.sum(axis=0) + held)[:, None, None]
        prior, moved, t = p[:, 0].mean(), np.abs(new - t).max(), new
        if moved < 1e-5:
            break
    for k, name in enumerate(("good", "bad")):
        assert np.allclose([[model[name][r][v] for v in (-1, 0, 1)] for r in RULES], t[k], atol=1e-3)
        assert np.allclose([model[name][r][-1] for r in RULES], truth[name == "good"], atol=0.03)
    assert abs(model["prior"] - 0.7) < 0.02
    upside = [((-1,) * len(RULES), 10), ((1,) * len(RULES), 90)]
    assert all(m["good"][r][-1] <= m["bad"][r][-1] for m in (Q.fit_rules(upside), Q.fit_rules([])) for r in RULES)


def test_quality_rules_learn_a_rule_that_objects_to_a_third(spark):
    """A source in capitals draws one -1 vote on a third of the rows; junk draws several."""
    clean = lambda i: "\n".join(" ".join(f"w{chr(97 + k % 26)}rd{chr(97 + i % 26)}{chr(97 + (i // 26 + k) % 26)}e" for k in range(j, j + 8)) + "." for j in range(0, 64, 8)).replace("e w", "e, w", 9)
    junk = lambda i: " ".join(f"A#B$!{i * 31 + k * k}%!!" for k in range(60))
    rows = [(i, clean(i).upper() if i % 3 == 0 else junk(i) if i % 10 == 1 else clean(i)) for i in range(600)]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[i]["base_failed"] for i in got)
    assert all(got[i]["v_capitals"] == -1 and sum(got[i][f"v_{r}"] == -1 for r in RULES) == 1 for i in range(0, 600, 3))
    assert {i for i in got if not got[i]["kept"]} == {i for i in range(600) if i % 3 and i % 10 == 1}


BASE = {
    "assign": re.compile(r"""(?P<k>[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_by_force(t):
    found = [("assign", *m.span()) for m in BASE["assign"].finditer(t) if len(m["v"]) >= 6]
    found += [("access", *m.span()) for m in BASE["access"].finditer(t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in BASE["hex"].finditer(t) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


SECRETS = ["password=abcdef token: 'zzz' secret = \"Xk39fj2lQQ9z\"", "AKIA" + "A1" * 9, "AKIA" + "A" * 15, "é" * 3 + "f" * 24 + " " + "f" * 23, "PASSWD : qwerty123", "api_key=api-key=123456", "my pwd is h7Kp9vQ2mZ ok", "paſſword=abcdefgh", "login: password"]


def test_secret_spans(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(SECRETS, 100)), "doc_id long, text string"))
    want = {(r["doc_id"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_by_force(r["text"] or "")).encode()).hexdigest()) for r in docs.collect()}
    got = secret_scans.find_secrets(docs).collect()
    assert {(r["doc_id"], r["base_sha256"]) for r in got} == want and len(got) == docs.count()
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[106] == "guess:10:20" and spans[108] == ""
    assert secret_scans.find_secrets(no_docs).count() == 0 and secret_scans.mask_secrets(no_docs).count() == 0
    assert secret_scans.mask_secrets(odd_docs, WORD).columns == odd_docs.columns
    masked = {r["doc_id"]: r["text"] for r in secret_scans.mask_secrets(docs).collect()}
    assert "[hex]" in masked[103] and "Xk39" not in masked[100] and masked[2] is None


@pytest.mark.parametrize("text", ["DB_PASSWORD=P@ssw0rd!Xy9#qL", "SMTP_PASS=q8Zr!vv92Lk", "user_pwd=Zk39xQp7tt", "DJANGO_SECRET_KEY='x9$kf!2mQz&7'", "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG+bPxRfiCY"])
def test_names_with_a_prefix_are_contexts(text):
    value = re.split(r"\s*=\s*", text, maxsplit=1)[1].strip("'")
    at = text.index(value)
    assert ("guess", at, at + len(value)) in secret_scans.spans(text, WORD) and value[4:] not in secret_scans.mask(text, WORD)


def test_prose_gives_no_guess_span():
    prose = ["the secret is simple", "his login is required.", "the token is important", "pin is broken", "The password is case-sensitive", "a login is user-dependent", "le token is nécessaire", "PIN is REQUIRED", "the pin is 4-digit"]
    prose += ["login: required", "password = changeme", "token: bearer", "secret: chocolate", "pin: 1234567", "auth = disabled", "passphrase: correcthorse"]
    guessed = lambda t: [x for x in secret_scans.spans(t, WORD) if x[0] == "guess"]
    assert {t: guessed(t) for t in prose if guessed(t)} == {}
    for t in ("password is Xk39fj2lQ", "pin is 48397057", "the secret is kq!zvw?xb"):
        assert [k for k, _, _ in secret_scans.spans(t, WORD)] == ["guess"], t


def segment_by_force(s):
    """The cost of one segment by itself, each pattern spelt out."""
    S, best = secret_scans, math.inf
    if len(s) == 1:
        return S.brute_cost(s)
    ranked = S.ranks(WORD)
    for one in "il":
        plain = "".join({"0": "o", "1": one, "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"}.get(c, c) for c in s.lower())
        for w in (s.lower(), plain):
            if w in ranked and len(w) >= 3:
                ups = sum(c.isupper() for c in s)
                extra = 0 if not ups else 1 if s.isupper() or (ups == 1 and s[0].isupper()) else ups
                best = min(best, ranked[w] + 0.3 * sum(x != y for x, y in zip(s.lower(), w, strict=True)) + 0.3 * extra)
    year = lambda y: 1900 <= int(y) <= 2049
    if re.fullmatch(r"\d{4}", s) and year(s):
        best = min(best, 2.1)
    for y, m, d in itertools.product((r"\d{4}", r"\d{2}"), (r"\d{2}", r"\d"), (r"\d{2}", r"\d")):
        for sep in ("", "-", "/", r"\.", "_"):
            if sep or (m == d == r"\d{2}"):
                for order in ("ymd", "dmy", "mdy"):
                    x = re.fullmatch(sep.join({"y": f"(?P<y>{y})", "m": f"(?P<m>{m})", "d": f"(?P<d>{d})"}[k] for k in order), s)
                    if x and 1 <= int(x["m"]) <= 12 and 1 <= int(x["d"]) <= 31 and (len(x["y"]) == 2 or year(x["y"])):
                        best = min(best, 4.6)
    if len(s) >= 3:
        ways = [S._walk_step(a, b) for a, b in itertools.pairwise(s)]
        if all(ways):
            best = min(best, 1.67 + 0.8 * sum(a != b for a, b in itertools.pairwise(ways)))
        for kind in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            if s in kind or s in kind[::-1]:
                best = min(best, 1.4)
    for unit in range(1, 9):
        k = len(s) // unit
        if s == s[:unit] * k and k >= (3 if unit == 1 else 2):
            best = min(best, cost_by_force(s[:unit]) + 0.5)
    return best + 0.3


def cost_by_force(value):
    """The cheapest of all segmentations."""
    if not value:
        return 0.0
    return min(sum(segment_by_force(value[a:b]) for a, b in itertools.pairwise((0, *cuts, len(value)))) for k in range(len(value)) for cuts in itertools.combinations(range(1, len(value)), k))


def test_guess_costs_are_the_cheapest_segmentation():
    cost = lambda x: secret_scans.guess_cost(x, WORD)
    r = np.random.default_rng(6)
    pieces = ["pass", "w0rd", "Love", "qwe", "rty", "1qaz", "12", "1999", "31", "aaa", "ab", "abab", "xyz", "cba", "Q", "$", "7", "zxc", "2/3/01", "lP"]
    for _ in range(150):
        value = "".join(r.choice(pieces, r.integers(1, 4)))[:10]
        assert cost(value) == pytest.approx(cost_by_force(value)), value
        enough = secret_scans.guess_cost(value, WORD, 4.0)
        assert (enough >= 4.0) == (cost(value) >= 4.0)
    assert cost("") == 0 and cost("password") < cost("password1") < cost("xQ7!vB29")
    for weak in ("hellopqrst", "1qaz2wsx3edc", "12/31/1999", "liverpool", "computer", "basketball", "Liverpool2019", "l1verp00l!", "aaaaaaaaaaaaaaaa", "abcabcabcabc", "qwertyuiop", "20240131"):
        assert cost(weak) < secret_scans.LEAST_COST, (weak, cost(weak))
    for strong in ("Xk39fj2lQQ9z", "h7Kp9vQ2mZ", "x9$kf!2mQz&7"):
        assert cost(strong) >= secret_scans.LEAST_COST
    assert secret_scans.guess_cost("x9$kf!2mQz&7" * 100_000, WORD, 8.0) >= 8


@pytest.mark.parametrize("text", [b"", b"a", b"\xff" * 576, bytes(range(256)) * 9, b"\x00\xff" * 3000, b"x" * 577])
def test_media_round_trip(text):
    (avi,) = media._stored([text])
    frames, rate = media.read_avi(avi)
    samples = media.decode_frames(frames)
    assert samples.tobytes() == media.payload(text) and len(media.payload(text)) % 576 == 0 and rate == 25
    assert media.payload(text).startswith(text)


def test_media_rejects_damage():
    (avi,) = media._stored([b"hello"])
    with pytest.raises(ValueError):
        media.read_avi(b"RIFX" + avi[4:])
    with pytest.raises(ValueError):
        media.decode_frames([media.HEAD[:-1] + b"\x01" + media.TAIL])


def test_shots():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 64, (20, 576), np.uint8), rng.integers(128, 255, (15, 576), np.uint8)
    assert media.shots(media.histograms(np.concatenate([a, b]))) == [(0, 20), (20, 35)]
    assert media.shots(media.histograms(a)) == [(0, 20)]


def jpeg_by_hand(parts, width, height, quant, restart=0):
    """A baseline frame from quantised coefficients, with tables of fixed code lengths: parts [(h, v, blocks[row][column] of 64 in stored order)]."""
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\x00") + segment(0xDB, b"\x03" + bytes(quant))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 3]) for i, (h, v, _) in enumerate(parts)))
    out += segment(0xC4, b"\x01" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + segment(0xC4, b"\x12" + bytes([0] * 8 + [255] + [0] * 7) + bytes(range(255)))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    out += segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0x12]) for i in range(len(parts))) + b"\x00\x3f\x00")
    across, down = max(h for h, _, _ in parts), max(v for _, v, _ in parts)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    amount = lambda x: ((n := abs(x).bit_length()), format(x if x > 0 else x + (1 << n) - 1, f"0{n}b") if n else "")
    bits, last, n = "", [0] * len(parts), 0
    flush = lambda bits: bytes(int(x, 2) for x in map("".join, zip(*[iter(bits + "1" * (-len(bits) % 8))] * 8, strict=True))).replace(b"\xff", b"\xff\x00")
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            out, bits, last, n = out + flush(bits) + bytes([0xFF, 0xD0 + n % 8]), "", [0] * len(parts), n + 1
        for i, (h, v, blocks) in enumerate(parts):
            for y in range(v):
                for x in range(h):
                    b = blocks[unit // columns * v + y][unit % columns * h + x]
                    size, word = amount(b[0] - last[i])
                    bits, last[i], run = bits + format(size, "04b") + word, b[0], 0
                    for c in b[1 : max([k for k in range(64) if b[k]], default=0) + 1]:
                        if c:
                            bits += format(15 << 4, "09b") * (run // 16)
                            size, word = amount(c)
                            bits, run = bits + format((run % 16) << 4 | size, "09b") + word, -1
                        run += 1
                    if not b[63]:
                        bits += format(0, "09b")
    return out + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("sampling", "restart"), [([(1, 1)], 0), ([(2, 2)], 3), ([(1, 1)] * 3, 0), ([(2, 2), (1, 1), (1, 1)], 2)])
def test_frames_of_other_encoders(sampling, restart):
    """Own tables, AC terms, colour, subsampling and restarts, against the transform's double sum."""
    r = random.Random(3)
    width, height, quant = 43, 27, [r.randrange(1, 30) for _ in range(64)]
    single = len(sampling) == 1
    across, down = (1, 1) if single else (max(h for h, _ in sampling), max(v for _, v in sampling))
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    block = lambda: [r.randrange(-60, 60)] + [r.randrange(-9, 9) if r.random() < 0.2 else 0 for _ in range(63)]
    parts = [((1, 1) if single else (h, v)) + ([[block() for _ in range(columns * (1 if single else h))] for _ in range(rows * (1 if single else v))],) for h, v in sampling]
    got = luminance(jpeg_by_hand(parts, width, height, quant, restart))
    assert got.shape == (height, width)
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    for y, x in [(0, 0), (height - 1, width - 1), *((r.randrange(height), r.randrange(width)) for _ in range(60))]:
        b = parts[0][2][y // 8][x // 8]
        want = 128 + sum(
            b[k] * quant[k] / 4 * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * math.cos((2 * (y % 8) + 1) * u * math.pi / 16) * math.cos((2 * (x % 8) + 1) * v * math.pi / 16)
            for k, (u, v) in enumerate(order)
        )
        assert abs(min(255, max(0, want)) - got[y, x]) <= 0.51


def test_own_frames_by_the_general_decoder():
    text = bytes(random.Random(1).randrange(256) for _ in range(700))
    (avi,) = media._stored([text])
    frames, _ = media.read_avi(avi)
    samples = np.stack([luminance(f)[::8, ::8].ravel() for f in frames])
    assert samples.tobytes() == media.payload(text) and all((luminance(f).reshape(24, 8, 24, 8) == luminance(f)[::8, None, ::8, None].reshape(24, 1, 24, 1)).all() for f in frames)


def test_clips_of_any_file(spark):
    r = random.Random(5)
    shot = lambda level, n: [jpeg_by_hand([(1, 1, [[[level + r.randrange(3)] + [0] * 63 for _ in range(4)] for _ in range(3)])], 32, 24, [8] * 64) for _ in range(n)]
    other = media.write_avi(shot(-80, 12) + shot(70, 9))
    no_index = media.write_avi(shot(0, 4))
    at = no_index.rindex(b"idx1")
    no_index = b"RIFF" + struct.pack("<I", at - 8) + no_index[8:at]
    empty = media._chunk(b"RIFF", b"AVI " + other[12 : other.index(b"movi") - 8] + media._chunk(b"LIST", b"movi") + media._chunk(b"idx1", b""))
    files = [(1, other), (2, no_index), (3, empty), (4, None), (5, b"RIFF"), (6, other[: len(other) // 2]), (7, other.replace(b"\xff\xc0", b"\xff\xc2"))]
    got = {}
    for x in media.clips(spark.createDataFrame(files, "doc_id long, media binary")).collect():
        got.setdefault(x["doc_id"], []).append((x["first_frame"], x["frames"], x["error"]))
    assert got[1] == [(0, 12, None), (12, 9, None)] and got[2] == [(0, 4, None)]
    assert {k: v[0][2] for k, v in got.items() if k > 2} == {3: "no frames", 4: "no file", 5: "a damaged AVI file", 6: "not an AVI file", 7: "not a baseline JPEG frame"}


def test_media_query(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = media.media_digests(odd_docs).collect()
    want = sorted(((r["doc_id"], len(t), hashlib.sha256(media.payload(t)).hexdigest(), zlib.crc32(media.payload(t)[-32:])) for r in rows for t in [(r["text"] or "").encode()]), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=str) == want
    assert media.media_digests(no_docs).count() == 0
    clips = media.clips(media.store(odd_docs)).groupBy("doc_id").agg({"frames": "sum"}).collect()
    assert {r["doc_id"] for r in clips} == {r["doc_id"] for r in rows}


def test_language(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    q = QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert (q["lang"] == q["lang_pred"]).mean() >= 0.98 and q["score"].between(0, 1).all()
    model = fit_languages(odd_docs)
    got = {r["doc_id"]: r["lang_pred"] for r in predict_languages(odd_docs, model).collect()}
    assert got[2] == got[3] == got[4] == got[9] == "und" and got[5] == "la"
    assert fit_languages(no_docs) is None and predict_languages(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in predict_languages(odd_docs, None).collect()} == {"und"}


def test_quality_classifier(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    q = QUERIES["op2_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (q["predicted"] == q["quality"]).mean() >= 0.98
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_quality(odd_docs, labels) is None
    assert {r["score"] for r in score_quality(odd_docs, None).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "good words here " * 9 + str(i) if i % 2 else "#$% !! ** " * 9 + str(i)) for i in range(40)], "doc_id long, text string")
    model = fit_quality(docs, labels)
    got = score_quality(odd_docs, model)
    assert got.count() == odd_docs.count() and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert score_quality(no_docs, model).count() == 0
    assert keep_good(docs, model).filter("doc_id % 2 = 1").count() == 20 and keep_good(docs, model).filter("doc_id % 2 = 0").count() == 0


def test_quality_scores_by_force(spark, odd_docs):
    """Scores from the dictionaries and weights alone, by zstandard's plain interface and one formula."""
    import zstandard

    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    text = lambda i, junk: " ".join(words[(i * 7 + k * k) % 7] + ("$#" if junk else "") for k in range(40 + i))
    docs = spark.createDataFrame([(i, text(i, i % 3 == 0)) for i in range(120)], "doc_id long, text string")
    model = fit_quality(docs, spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(120)], "doc_id long, quality int"))
    every = docs.unionByName(odd_docs.select("doc_id", "text"))
    size = lambda part, which: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(model[which]), write_content_size=False, write_dict_id=False).compress(part))
    want = []
    for r in every.collect():
        raw = (r["text"] or "").encode()
        gap = sum(size(raw[k : k + 1024], "bad") - size(raw[k : k + 1024], "good") for k in range(0, len(raw), 1024))
        want.append((str(r["doc_id"]), round(1 / (1 + np.exp(-(model["weights"][0] + model["weights"][1] * (gap + 4) / (len(raw) + 64)))), 9)))
    got = [(str(r["doc_id"]), round(r["score"], 9)) for r in score_quality(every, model).collect()]
    assert sorted(got) == sorted(want)
    kept = keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == score_quality(odd_docs, model).filter("score >= 0.5").count()
    assert keep_good(odd_docs, None).count() == odd_docs.count() and keep_good(odd_docs.limit(0), model).count() == 0


def test_languages_by_force(spark, odd_docs):
    """Nearest centroid of n-gram vectors built with dictionaries, one text at a time."""
    from sqlloom.llm import language_id as L

    known = spark.createDataFrame([(i, ("der hund und die katze %d" if i % 2 else "le chien et le chat %d") % (i % 7), "de" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = fit_languages(known)

    def by_force(t):
        if not t or not any(c.isalpha() for c in t):
            return "und", 0.0
        c = re.sub(r" +", " ", "".join(x if x.isalpha() else " " for x in t.lower()))
        n = np.zeros(L.DIMS)
        for width in (1, 2, 3):
            for i in range(len(c) - width + 1):
                h = (ord(c[i]) + 1) * 0x9E3779B1 % 2**32
                for x, by in zip(c[i + 1 : i + width], (0x85EBCA77, 0xC2B2AE3D), strict=False):
                    h = (h ^ ord(x)) * by % 2**32
                n[h >> 20] += 1
        v = np.log1p(n) * model["idf"]
        cos = model["centroids"] @ (v / np.linalg.norm(v))
        best = [max(cos[a:b]) for a, b in zip(model["starts"], [*model["starts"][1:], len(cos)], strict=True)]
        return model["names"][int(np.argmax(best))], float(1 / np.exp(L.SHARPNESS * (np.array(best) - max(best))).sum())

    docs = odd_docs.select("doc_id", F.substring("text", 1, 3000).alias("text")).unionByName(known.select("doc_id", "text"))
    want = [(str(r["doc_id"]), n, round(p, 6)) for r in docs.collect() for n, p in [by_force(r["text"])]]
    assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in predict_languages(docs, model).collect()) == sorted(want)


def test_oracles_name_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
