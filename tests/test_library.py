"""Text functions, sources, fuzzy matching, execution, learning, candidate loop, streams."""

import json
import sqlite3

import duckdb
import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from sqlloom import queries as q
from sqlloom.functions import text as T
from sqlloom.functions.edits import each
from sqlloom.functions.register import register, register_corpus
from sqlloom.operators import corpus, fuzzy, history, metrics
from sqlloom.plans import catalyst
from sqlloom.plans.compare import multiset_diff, same_result
from sqlloom.samples import WIRE
from sqlloom.sources import catalog, files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db


def plain(rows):
    cell = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in q.ORACLE_SQL if n not in ("repair_corpus", "mutate_corpus_checks")])
def test_against_duckdb(spark, sf_dir, duck, name):
    df = q.QUERIES[name](spark, sf_dir)
    rel = duck.sql(q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.select(*sorted(df.columns)).collect()) == plain(rel.select(*sorted(rel.columns)).fetchall())


def one(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_text(spark):
    assert one(spark, ["ENUM('a')", "INTERVAL"], T.normalize_type(F.col("x"), strict=True)) == ["text", "time"]
    assert one(spark, ["a%b_c\\"], T.escape_like(F.col("x"))) == ["a\\%b\\_c\\\\"]
    assert one(spark, [0.125, 1500.0], T.duration(F.col("x")), "x double") == ["0 ms", "1.5 s"]
    assert one(spark, [0.125], T.percent(F.col("x")), "x double") == ["12.5%"]
    assert one(spark, ["a,b", 'say "x"', None, "plain"], T.csv_cell(F.col("x"))) == ['"a,b"', '"say ""x"""', "", "plain"]
    assert one(spark, ["SELECT a, FROM t, u"], each(F.col("x"), ",", "")) == [["SELECT a FROM t, u", "SELECT a, FROM t u"]]
    c = catalog.from_wire(spark, "star", WIRE)
    ddl = {r[0]: r[1] for r in c.select("table_name", T.ddl(F.col("table_name"), F.col("columns"), F.col("primary_keys"), F.col("foreign_keys"))).collect()}
    db = sqlite3.connect(":memory:")
    for x in ddl.values():
        db.execute(x)
    assert "PRIMARY KEY" in ddl["lineitem"] and ddl["region"].count("PRIMARY KEY") == 1


def test_canonical_form(spark):
    form = lambda x: one(spark, [x], T.canonical_form(F.col("x")))[0]
    a = form("SELECT a.x FROM t AS a JOIN u b ON a.i=b.i WHERE a.x = 'it''s' AND b.y > 2.5;")
    assert a == form("select T1.x from t T1 join u as T2 on T1.i = T2.i  where T1.x = 'q' and T2.y > 7") and "t1.x" in a
    assert a != form("SELECT b.x FROM t AS a JOIN u b ON a.i=b.i WHERE a.x = 'it''s' AND b.y > 2.5") and form("SELECT x1 FROM t2") == "select x1 from t2"


def test_mutation_choices(spark):
    from sqlloom.operators.mutate import FILLERS, random_text

    got = [r[0] for r in spark.range(400).select(random_text(F.array(F.lit("Peru"), F.lit("12"), F.lit("")), F.col("id"))).collect()]
    assert set(got) == {"Peru", *FILLERS} and 230 < got.count("Peru") < 330


def test_reports_hold_all_rows(spark, tmp_path):
    files.write_report({"T": spark.range(2500)}, f"{tmp_path}/r.md")
    files.write_results({"T": spark.range(2500), "none": spark.range(0)}, f"{tmp_path}/r.json")
    got = json.loads((tmp_path / "r.json").read_text())
    assert len((tmp_path / "r.md").read_text().splitlines()) == 2505 and len(got["T"]) == 2500 and got["none"] == []


def test_places_number_groups_of_any_size(spark):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("v"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "a").alias("g"), "id")
    got = corpus.places(rows, "g", "v", "id").collect()
    for g in ("a", "b", None):
        own = sorted((r["v"], r["id"], r["place"]) for r in got if r["g"] == g)
        assert [x[2] for x in own] == list(range(1, 1001))


def test_fuzzy(spark):
    pairs = spark.createDataFrame([("FORM", "FROM"), ("ca", "abc"), ("same", "SAME"), ("", "ab")], "a string, b string")
    assert [r[0] for r in pairs.select(fuzzy.osa_distance("a", "b")).collect()] == [1, 3, 0, 2]
    words = spark.createDataFrame([(w,) for w in ("FORM", "SELEC", "WHRE", "GROPU", "ODER")], "word string")
    assert {r["word"]: r["keyword"] for r in fuzzy.keyword_matches(words).filter("place = 1").collect()} == {"FORM": "FROM", "SELEC": "SELECT", "WHRE": "WHERE", "GROPU": "GROUP", "ODER": "ORDER"}
    near = fuzzy.closest(spark.createDataFrame([("d", "singr")], "db string, word string"), spark.createDataFrame([("d", "singer"), ("d", "stadium"), ("e", "singr")], "db string, option string"), ["db"])
    assert [r["option"] for r in near.collect()] == ["singer"]


def test_catalog_sources(spark, tmp_path):
    c = catalog.checked(catalog.from_wire(spark, "star", WIRE))
    want = {r["table_name"]: [(x["name"], x["type"]) for x in r["columns"]] for r in c.collect()}
    for notation in ({"t": ["a", "b"]}, {"t": {"columns": ["a", "b"]}}, {"t": {"columns": [{"name": "a"}, {"name": "b", "type": "INT"}]}}, {"t": {"columns": {"a": "", "b": "INT"}}}):
        assert [x["name"] for x in catalog.from_wire(spark, "d", notation).first()["columns"]] == ["a", "b"]
    path = tmp_path / "star.sqlite"
    db = sqlite3.connect(path)
    for (x,) in c.select(T.ddl(F.col("table_name"), F.col("columns"), F.col("primary_keys"), F.col("foreign_keys"))).collect():
        db.execute(x)
    db.commit()
    db.close()
    got = catalog.read_sqlite(spark, f"file://{path}")
    assert {r["table_name"]: [(x["name"], x["type"]) for x in r["columns"]] for r in got.collect()} == want and got.first()["db_id"] == "star"
    ddl = spark.createDataFrame([("d", "CREATE TABLE a (id SERIAL PRIMARY KEY, t VARCHAR(3)); CREATE TABLE b (x INT REFERENCES a(id));")], "db_id string, ddl string")
    rows = {r["table_name"]: r for r in catalog.from_ddl(ddl).collect()}
    assert rows["a"]["primary_keys"] == ["id"] and rows["b"]["foreign_keys"][0]["target_table"] == "a" and rows["a"]["columns"][1]["raw_type"] == "VARCHAR(3)"
    files.write_schemas(c.withColumn("columns", F.transform("columns", lambda x: F.struct(x["name"].alias("name"), x["raw_type"].alias("raw_type")))), f"{tmp_path}/registry")
    assert {r["table_name"] for r in catalog.read_registry(spark, f"{tmp_path}/registry").collect()} == set(want)
    spider = [{"db_id": "s", "table_names_original": ["t", "u"], "column_names_original": [[-1, "*"], [0, "a"], [0, "b"], [1, "c"]], "column_types": ["text", "number", "text", "number"], "primary_keys": [1], "foreign_keys": [[3, 1]]}]
    (tmp_path / "tables.json").write_text(json.dumps(spider))
    s = {r["table_name"]: r for r in catalog.read_spider_tables(spark, f"{tmp_path}/tables.json").collect()}
    assert [x["name"] for x in s["t"]["columns"]] == ["a", "b"] and s["t"]["primary_keys"] == ["a"] and s["u"]["foreign_keys"][0]["target_column"] == "a"
    with pytest.raises(Exception, match="invalid schema"):
        catalog.checked(catalog.from_wire(spark, "bad", {"t": {"columns": []}})).collect()
    assert catalog.sizes(c).first()["columns"] == 33


def test_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿query,db_id\n"SELECT ""a"",\n1",m\nSELECT 2,\n', encoding="utf-8")
    rows = files.read_queries_csv(spark, f"{tmp_path}/q.csv", "dflt").collect()
    assert [tuple(r) for r in rows] == [('SELECT "a",\n1', "m"), ("SELECT 2", "dflt")]
    assert files.unknown_databases(spark.createDataFrame(rows), catalog.from_wire(spark, "m", WIRE)).collect()[0]["db_id"] == "dflt"
    (tmp_path / "bad.csv").write_text("sql\nx\n")
    with pytest.raises(ValueError):
        files.read_queries_csv(spark, f"{tmp_path}/bad.csv")
    df = spark.createDataFrame([(1, ["a", "b"], None)], "id int, tags array<string>, note string")
    files.write_csv(df, f"{tmp_path}/out")
    assert "a; b" in "".join(f.read_text() for f in (tmp_path / "out").glob("*.csv"))
    files.write_report({"T": df}, f"{tmp_path}/r.md")
    files.write_results({"T": df}, f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text())["T"][0]["tags"] == ["a", "b"] and "| id |" in (tmp_path / "r.md").read_text()
    made = []
    for _ in range(2):
        files.cached(spark, f"file://{tmp_path}/cache", lambda: made.append(1) or df)
    assert len(made) == 1


def test_history(spark):
    h = spark.createDataFrame([(1, "c", "q", "100% SURE", None, 1), (2, "c", "q", "x_y", "SYNTAX_ERROR", 2), (3, "d", "r", "xay", None, 3)], "id long, client_id string, kind string, title string, error_class string, created_at long")
    assert [r["id"] for r in history.search(h, "0% s").collect()] == [1] and [r["id"] for r in history.search(h, "x_").collect()] == [2]
    assert [r["id"] for r in history.search(h, "syntax", client="c").collect()] == [2]
    with pytest.raises(ValueError):
        history.page(h, 201, 0, F.col("id"))
    assert {r["id"] for r in history.newest(h, "client_id", "created_at", "id", 1).collect()} == {2, 3}
    change = h.filter("id = 1").withColumn("title", F.lit("new")).withColumn("deleted", F.lit(False)).unionByName(h.filter("id = 2").withColumn("deleted", F.lit(True)))
    assert {(r["id"], r["title"]) for r in history.upsert(h, change, "id").collect()} == {(1, "new"), (3, "xay")}
    big = h.withColumn("result", F.repeat(F.lit("x"), 600_000)).withColumn("title", F.repeat(F.lit("t"), 5000))
    assert tuple(history.storable(big).selectExpr("length(title)", "result").first()) == (4000, None)


def test_metrics_corners(spark):
    assert metrics.mcnemar_p(0, 0) == 1.0 and metrics.mcnemar_p(1, 9) == pytest.approx(0.021484375) and metrics.mcnemar_p(2000, 2000) == 1.0
    empty = spark.createDataFrame([], "y_true string, y_pred string, confidence double")
    assert metrics.class_report(empty).filter("f1 <> 0 or support <> 0").count() == 0 and metrics.macro_scores(empty).first()["accuracy"] == 0
    p = spark.createDataFrame([("CORRECT", "CORRECT", 1.0), ("CORRECT", "SYNTAX_ERROR", 0.0)], "y_true string, y_pred string, confidence double")
    assert metrics.reliability(p).count() == 1


def test_corpus_choices(spark):
    rows = spark.createDataFrame([(i, f"g{i % 7}", "ab"[i % 2]) for i in range(200)], "id long, g string, label string")
    for f in (lambda d: corpus.split_by_group(d, "g"), lambda d: corpus.quota(d, "label", 9, "id"), lambda d: corpus.weighted_order(d.withColumn("w", F.col("id") + 1), "label", "w", "id")):
        assert sorted(map(tuple, f(rows).collect())) == sorted(map(tuple, f(rows.repartition(7)).collect()))
    s = corpus.split_by_group(rows, "g")
    assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n <> 1").count() == 0 and s.filter("split = 'validation'").select("g").distinct().count() == 1
    queries = spark.createDataFrame([("m", f"SELECT {i} FROM orders", "CORRECT", ["orders"]) for i in range(40)], "db_id string, sql string, label string, tables array<string>")
    p = corpus.policy_rows(queries, catalog.from_wire(spark, "m", WIRE)).collect()
    assert len(p) == 40 and all((r["policy"]["restricted_tables"] == ["orders"]) == (r["label"] == "PERMISSION_DENIED") for r in p) and len({r["label"] for r in p}) == 2
    assert corpus.length_batches(rows.withColumn("t", F.repeat(F.lit("x"), F.col("id").cast("int"))), "t", 4).count() == 200


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT julianday(TIMESTAMP'2020-01-01'), strftime('%Y-%m', TIMESTAMP'2020-03-01'), quote_ident('a\"b'), osa_distance('FORM', 'FROM'), sql_normalize(' x ; ')").first()[:] == (2458849.5, "2020-03", '"a""b"', 1, "x")
    assert spark.sql("SELECT total(collect_list(CAST(id AS DOUBLE))), group_concat(collect_list(CAST(id AS STRING))) FROM range(3)").first()[:] == (3.0, "0,1,2")
    spark.createDataFrame([(1, "star", "SELECT r_nme FROM region")], "id long, db_id string, sql string").createOrReplaceTempView("asked")
    register_corpus(spark, "asked", catalog.from_wire(spark, "star", WIRE))
    assert spark.sql("SELECT d.error_class, i.token, r.repaired_query FROM sql_diagnose d JOIN sql_issues i USING (id) JOIN sql_repair r USING (id)").first()[:] == ("UNKNOWN_COLUMN", "r_nme", "SELECT r_name FROM region")
    assert [r[0] for r in spark.sql("SELECT token FROM sql_tokens('SELECT f(a) FROM t') ORDER BY idx").collect()] == ["SELECT", "f", "(", "a", ")", "FROM", "t"]
    assert [r[0] for r in spark.sql("SELECT query FROM split_queries('SELECT '';''; SELECT 2') ORDER BY idx").collect()] == ["SELECT ';'", "SELECT 2"]
    assert ("removed", "b") in [tuple(r) for r in spark.sql("SELECT kind, part FROM word_diff('a b c', 'a x c')").collect()]


def test_functions_of_tables(spark):
    register(spark)
    spark.createDataFrame([(1, "SELECT f(a)", 9), (2, None, 9), (3, "", 9)], "Id long, sql string, other int").createOrReplaceTempView("texts")
    df = spark.sql("SELECT * FROM query_tokens(TABLE(texts), 'id', 'sql')")
    assert df.columns == ["Id", "idx", "token", "depth"] and sorted(map(tuple, df.collect())) == [(1, 0, "SELECT", 0), (1, 1, "f", 0), (1, 2, "(", 0), (1, 3, "a", 1), (1, 4, ")", 0)]
    for wrong in ("TABLE(texts), 'id', 'nothing'", "TABLE(texts), 'id', 'id'"):
        with pytest.raises(Exception, match="column"):
            spark.sql(f"SELECT * FROM query_tokens({wrong})").collect()
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), ("b", 1, "y"), (None, 1, "y")], "who string, at int, v string").createOrReplaceTempView("seen")
    got = spark.sql("SELECT * FROM runs(TABLE(seen) PARTITION BY who ORDER BY (at), 'who', 'v', 'at')").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 1, "x", 2, 1, 2), ("a", 2, None, 2, 3, 4), ("a", 3, "x", 1, 5, 5), ("b", 1, "y", 1, 1, 1), (None, 1, "y", 1, 1, 1)], key=repr)
    assert spark.sql("SELECT * FROM runs(TABLE(SELECT * FROM seen WHERE false) PARTITION BY who ORDER BY (at), 'who', 'v', 'at')").count() == 0


def test_catalyst(spark):
    catalyst.create_views(spark, catalog.from_wire(spark, "star", WIRE), "star")
    cases = {
        "SELECT c_name FROM customer": "CORRECT", "SELECT c_name, FROM customer": "SYNTAX_ERROR", "SELECT c_name FROM customer WHERE": "SYNTAX_ERROR", "SELECT x FROM customer": "UNKNOWN_COLUMN",
        "SELECT x FROM nope": "UNKNOWN_TABLE", "SELECT c_name FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey": "AMBIGUOUS_REFERENCE",
    }
    assert {s: catalyst.check(spark, s)[0] for s in cases} == cases
    got = catalyst.execute(spark, "SELECT id, CAST('NaN' AS DOUBLE) AS x FROM range(10)", limit=3)
    assert got["row_count"] == 3 and got["truncated"] and got["rows"][0] == [0, None]
    with pytest.raises(TimeoutError):
        catalyst.execute(spark, "SELECT sum(a.id * b.id % 7) FROM range(3000000) a JOIN range(3000000) b ON a.id % 11 <> b.id % 13", seconds=3)
    assert catalyst.execute(spark, "SELECT 'reflect(x) text.`y`' AS x")["row_count"] == 1
    for bad in ("SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('java.util.UUID', 'randomUUID')", "SELECT * FROM text.`/etc/hosts`", "SELECT * FROM `csv`.`/x`", "DROP TABLE x", "CREATE TABLE x (a INT)", "INSERT INTO x VALUES (1)", "SET a=1"):
        with pytest.raises(ValueError):
            catalyst.execute(spark, bad)


def test_results(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert multiset_diff(a, spark.createDataFrame([(1,), (2,), (2,)], "x int")).count() == 2
    assert same_result(a, spark.createDataFrame([(2,), (1,), (1,)], "y int")) and not same_result(a, a.selectExpr("cast(x as double)"))
    big = spark.range(2000).repartition(5)
    assert same_result(big.orderBy("id"), big.orderBy("id").repartitionByRange(3, "id").sortWithinPartitions("id"), "SELECT id FROM t ORDER BY id")
    assert not same_result(a.coalesce(1).orderBy("x"), a.coalesce(1).orderBy(F.col("x").desc()), "SELECT x FROM t ORDER BY x")


def test_baseline(spark, tmp_path):
    from sqlloom.operators.baseline import fit, load, predict, save

    rows = spark.createDataFrame([(f"SELECT a{i} FROM t{i % 3}" if i % 2 else f"SELEC a{i} FORM t{i % 3}", "CORRECT" if i % 2 else "SYNTAX_ERROR") for i in range(60)], "text string, label string")
    save(fit(rows, vocabulary=2000), f"file://{tmp_path}/m", {"rows": 60})
    model, known = load(f"file://{tmp_path}/m")
    assert known == {"rows": 60}
    p = predict(model, rows)
    assert p.filter("label = y_pred").count() >= 58 and p.filter("confidence < 0.5 or size(probabilities) <> 2").count() == 0


def test_candidate_loop(spark):
    from sqlloom.operators.nl2sql import answer

    questions = spark.createDataFrame([(i, "star") for i in range(5)], "question_id long, db_id string")
    generated = spark.createDataFrame(
        [
            (0, 1, "```sql\nSELECT r_name FROM region;\n```"), (1, 1, "SELECT r_nme FROM region"), (1, 2, "SELECT r_regionkey FROM region"), (2, 1, "SELECT r_nmae FROM region"),
            (3, 1, "SELECT p_name FROM part WHERE p_size = 'unknown'"), (4, 1, " "),
        ], "question_id long, rank int, answer string",
    )
    got = {r["question_id"]: (r["status"], r["sql"]) for r in answer(questions, generated, catalog.from_wire(spark, "star", WIRE)).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "valid", 1: "valid_alternative", 2: "repaired", 3: "invalid", 4: "no_candidate"}
    assert got[1][1] == "SELECT r_regionkey FROM region" and got[2][1] == "SELECT r_name FROM region"


READS = [
    "SELECT name FROM singer",
    "SELECT count(*), max(id) FROM singer WHERE id > 1 GROUP BY name HAVING count(*) > 1 ORDER BY 1 LIMIT 3",
    "WITH a AS (SELECT * FROM singer) SELECT * FROM a JOIN singer USING (id)",
    "SELECT * FROM singer WHERE id IN (SELECT id FROM singer s2 WHERE EXISTS (SELECT 1 FROM singer))",
    "SELECT (SELECT max(id) FROM singer)",
    "SELECT 1",
    "SELECT * FROM VALUES (1,2) AS t(a,b)",
    "SELECT * FROM range(5)",
    "SELECT id, row_number() OVER (PARTITION BY name ORDER BY id) FROM singer",
    "SELECT id FROM singer UNION SELECT id FROM singer EXCEPT SELECT 1",
    "SELECT DISTINCT upper(name) || 'java_method(' FROM singer AS T1 WHERE name LIKE '%text.`x`%'",
    "SELECT x FROM singer LATERAL VIEW explode(array(1,2)) t AS x",
    "SELECT name FROM singer TABLESAMPLE (10 ROWS)",
    "SELECT CASE WHEN id=1 THEN 'a' END, cast(id as string) FROM singer s WHERE id BETWEEN 1 AND 2 AND name IS NOT NULL",
]
REACHES = [
    "SELECT `java_method`('java.lang.System','getProperty','user.home')",
    "SELECT /*'*/ java_method('java.lang.System','getProperty','user.home')",
    "SELECT /*'*/ * FROM text.`/etc/hostname` -- '",
    "SELECT * FROM singer WHERE id = (SELECT max(1) FROM text.`/etc/hostname`)",
    "SELECT reflect('a','b')",
    "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a",
    "DROP TABLE singer",
    "INSERT INTO singer SELECT * FROM singer",
    "SELECT * FROM nope",
    "CREATE TABLE x AS SELECT 1",
    "SELECT input_file_name() FROM singer",
    "SELECT * FROM singer WHERE EXISTS (SELECT java_method('a','b'))",
    "SELECT * FROM read_files('/etc')",
    "SET x=1",
    "SHOW TABLES",
    "SELECT name FROM singer WHERE id IN (SELECT try_reflect('a','b'))",
    "SELECT * FROM singer LATERAL VIEW explode(array(java_method('a','b'))) t AS x",
    "SELECT transform(array(1), x -> java_method('a','b'))",
    "SELECT * FROM (SELECT * FROM text.`/etc/hostname`)",
    "SELECT max(java_method('a','b')) OVER () FROM singer",
    "SELECT TRANSFORM(id) USING 'cat' AS x FROM singer",
]


def test_the_guard_decides_on_the_parsed_plan(spark):
    spark.createDataFrame([(1, "a")], "id int, name string").createOrReplaceTempView("singer")
    for q in READS:
        assert catalyst.is_query(spark, q), q
        catalyst.execute(spark, q)
    for q in REACHES:
        try:
            assert not catalyst.is_query(spark, q), q
        except ParseException:
            pass
    spark.catalog.dropTempView("singer")


def test_canonical_forms_of_swapped_aliases(spark):
    base = "SELECT T2.a FROM t AS T2 JOIN u AS T1 ON T2.i=T1.i"
    cases = {base: True, "SELECT T1.a FROM t AS T1 JOIN u AS T2 ON T1.i=T2.i": True, "select  x.a FROM t x JOIN u y ON x.i = y.i ;": True, "SELECT T1.a FROM t AS T2 JOIN u AS T1 ON T2.i=T1.i": False, "SELECT T2.a FROM t AS T2 JOIN u AS T1 ON T2.i=T2.i": False}
    rows = spark.createDataFrame([(base, k) for k in cases], "a string, b string").select("b", (T.canonical_form(F.col("a")) == T.canonical_form(F.col("b"))).alias("same"))
    assert {r["b"]: r["same"] for r in rows.collect()} == cases


def test_export_ids_of_large_splits(spark, tmp_path):
    spark.range(140_000).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["split"], r["id"]) for r in q.QUERIES["export_ids"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(db.sql(q.ORACLE_SQL["export_ids"]).fetchall())
    # the operator's own ids stay apart
    rows = spark.range(100_002).select("id", F.lit("s").alias("split")).withColumnRenamed("id", "k")
    assert corpus.numbered_ids(rows, "split", "k").select("id").distinct().count() == 100_002


def test_made_texts_are_dealt_out(spark, sf_dir):
    made = q._classed(spark, sf_dir)
    used = {r[0] for r in made.select(F.spark_partition_id()).distinct().collect()}
    assert spark.read.parquet(f"{sf_dir}/customer.parquet").rdd.getNumPartitions() == 1 and len(used) >= 4


def test_canonical_form_is_worked_out_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("x")).select(T.canonical_form(F.col("x")).alias("form"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("natural|limit|having") == 1
