"""The check of a pattern against that of each text."""

import json

import pytest
from sqlloom.functions.scopes import pattern_of
from sqlloom.operators import diagnose


SCHEMA = json.dumps([{"ddl": 'CREATE TABLE "t" ("a" NUMERIC, "b" TEXT)', "t": "t", "cols": [{"c": "a", "k": "number"}, {"c": "b", "k": "text"}], "keys": ["a"]}])
VALUES = ("5", "'5'", "5.25", "'x'", "''", "'it''s'", "'A.B'", "'('", "99999999999999999999", "5x", "5e3", "0x5", "'é'", "5 .a", "'t'.a", "5é", "-5", "NULL", "b")
TEXTS = (
    "SELECT a FROM t WHERE a = {}", "SELECT b = {}, count(*) FROM t GROUP BY b = {}", "SELECT b = 5, count(*) FROM t GROUP BY b = {}", "SELECT a = {} FROM t UNION SELECT a FROM t ORDER BY a = {}",
    "SELECT a = 5 FROM t UNION SELECT a FROM t ORDER BY a = {}", 'SELECT * FROM (SELECT a = {} FROM t) WHERE "a = {}" = 1', "SELECT a FROM t WHERE b <> {} {}", "SELECT a FROM t WHERE b = 'x = {}", "SELECT a FROM t -- = {}\n WHERE a >= {}",
    "SELECT a FROM t WHERE {} = {} OR {} < b", "SELECT c FROM u WHERE d = {}", "SELECT sum(b) FROM t WHERE a == {} ORDER BY {}", "UPDATE t SET b = {}", "SELECT a FROM t WHERE b = [x = {}] AND a = {}",
)


@pytest.mark.parametrize("schema", [SCHEMA, None])
@pytest.mark.parametrize("restricted", [False, True])
def test_patterns_tell_what_each_text_tells(schema, restricted):
    texts = [t.replace("{}", v) for t in TEXTS for v in VALUES] + [t.replace("{}", "5", 1).replace("{}", v) for t in TEXTS for v in VALUES]
    for sql in texts:
        got, want = diagnose._checked(schema, sql, restricted), diagnose._checked_text(schema, sql, restricted)
        assert [got[0], got[1], json.dumps(got[2])] == [want[0], want[1], json.dumps(want[2])], sql
    assert sum(pattern_of(x) is not None for x in texts) > len(texts) / 2


def test_texts_of_one_pattern_are_read_once(monkeypatch):
    read, plain = [], diagnose.Query
    monkeypatch.setattr(diagnose, "Query", lambda *args: read.append(args[0]) or plain(*args))
    found = [diagnose._checked(SCHEMA, f"SELECT a FROM t WHERE a > {n} AND b = 'once {n}'", False) for n in range(1000)]
    assert len(read) == 1
    assert [[x["value"] for x in f[2][0]["compared"]] for f in found] == [[str(n), f"once {n}"] for n in range(1000)]


def test_a_corpus_takes_one_check_for_each_template(spark):
    """Orders' texts, as diagnose_corpus makes them: checks grow with the templates, not with the texts."""
    from sqlloom import samples

    texts = [t[0].replace("{n}", str(n)).replace("{s}", f"{n}-HIGH") for n in range(100, 300) for t in samples.LABELLED]
    patterns = {p[0] if (p := pattern_of(x)) else x for x in texts}
    assert len(texts) == 200 * len(samples.LABELLED) and len(patterns) < len(texts) / 2
