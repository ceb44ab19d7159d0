"""Drawn edits against all edits."""

from pyspark.sql import functions as F

from sqlloom.functions.edits import each, edited, edits, rewritten


def test_edits_make_the_texts_of_each(spark):
    """The texts that edits stand for are those of ``each``, in its order; none is made before it is drawn."""
    rows = spark.createDataFrame([(x,) for x in ("SELECT a, b FROM t, u", "", "a", None, ",,", "é, FROM 'it''s', x")], "x string")
    for pattern, new in ((",", ""), (r"[a-z]+", F.upper), (r"(?<=[ ,])(?=[a-z])", "("), ("FROM", lambda w: F.concat(w, w))):
        made = edits(F.col("x"), pattern, new)
        texts = rows.select(each(F.col("x"), pattern, new).alias("want"), F.transform(made, lambda e: edited(F.col("x"), e)).alias("got")).filter("x is not null").collect()
        assert [r["got"] for r in texts] == [r["want"] for r in texts] and any(r["got"] for r in texts), pattern
    one = rows.select(rewritten(F.col("x"), F.upper("x")).alias("e"), "x").filter("size(e) > 0").select(edited(F.col("x"), F.col("e")[0]).alias("t"), "x").collect()
    assert one and all(r["t"] == r["x"].upper() != r["x"] for r in one)
