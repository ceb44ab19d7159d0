"""Joins by order: points in intervals, overlapping intervals, and the nearest row before or after (as-of).

Spark runs a join by inequalities as a nested loop.  Here intervals and points meet by equality:
each interval lies in cells of a width that is at least its own, so it touches two at most, and
the ends are checked exactly.  Long and short intervals have cells of their own (widths are powers of four), so no
interval is cut into many pieces; a point looks once into each width that occurs.

As-of joins are one sorted pass over both sides together.  A key with more than ``piece_rows`` rows is
cut into pieces along the order; what the pass of a piece would have carried in is the last row of the pieces before it.

Defined results: null keys, points and ends match nothing (an as-of row without a match has nulls); intervals hold
their start and not their end, so empty and reversed ones match nothing; repeated rows match each for themselves; among rows of
equal place an as-of join takes the largest by all columns; order columns are numbers, dates or timestamps.
Right-hand columns carry a prefix, so names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import written

#: Widths of cells are powers of two, of multiples of this exponent.
STEP = 2


def ticks(df: DataFrame, name: str) -> Column:
    """A number in the order of the column: microseconds, days, or the number itself."""
    kind, c = df.schema[name].dataType.typeName(), F.col(name)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":  # without a time zone, so that the order never turns back
        seconds = F.hour(c) * 3600 + F.minute(c) * 60
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c) if kind == "date" else c


def _level(start: Column, end: Column) -> Column:
    """The exponent of the width of an interval's cells: the least multiple of STEP with a width of its length or more."""
    return (F.ceil(F.log2(end.cast("double") - start.cast("double")) / STEP) * STEP).cast("int")


def _cell(x: Column, level: Column) -> Column:
    # any function that never falls as x grows will do, whatever it rounds
    return F.floor(x.cast("double") / F.pow(F.lit(2.0), level)).cast("double")


def _cells(start: Column, end: Column, level: Column) -> Column:
    first, last = _cell(start, level), _cell(end, level)
    return F.when(first == last, F.array(first)).otherwise(F.array(first, last))


def _levels(df: DataFrame) -> Column:
    """The widths that occur, as an array: at most a few hundred exponents of doubles, whatever the rows."""
    return F.array(*(F.lit(r[0]) for r in df.select("_level").distinct().orderBy("_level").collect())).cast("array<int>")


def _right(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _spans(df: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    some = F.col(start) < F.col(end)
    for c in on:
        some = some & F.col(c).isNotNull()
    return df.withColumns({"_s": ticks(df, start), "_e": ticks(df, end)}).filter(some).withColumn("_level", _level(F.col("_s"), F.col("_e")))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, on: tuple[str, ...] | list[str] = (), prefix: str = "right_") -> DataFrame:
    """Every point with every interval that holds it, among rows equal in ``on``: the columns of both."""
    on = list(on)
    spans = _spans(intervals, on, start, end)
    levels = _levels(spans)
    spans = spans.withColumn("_cell", F.explode(_cells(F.col("_s"), F.col("_e"), F.col("_level"))))
    spans = _right(spans.drop("_s", "_e"), prefix)
    p = points.withColumn("_t", ticks(points, at)).filter(F.col("_t").isNotNull()).withColumn("_level", F.explode(levels)).withColumn("_cell", _cell(F.col("_t"), F.col("_level"))).drop("_t")
    fit = (F.col("_level") == F.col(f"{prefix}_level")) & (F.col("_cell") == F.col(f"{prefix}_cell"))
    for c in on:
        fit = fit & (F.col(c) == F.col(prefix + c))
    inside = (F.col(at) >= F.col(prefix + start)) & (F.col(at) < F.col(prefix + end))
    return p.join(spans, fit & inside).drop("_level", "_cell", f"{prefix}_level", f"{prefix}_cell")


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, on: tuple[str, ...] | list[str] = (), right_start: str | None = None, right_end: str | None = None, prefix: str = "right_") -> DataFrame:
    """Every two intervals that share a place, among rows equal in ``on``.

    A pair meets in the cells of the wider of both widths, and counts in that cell alone where its common part begins.
    """
    on, right_start, right_end = list(on), right_start or start, right_end or end
    a, b = _spans(left, on, start, end), _spans(right, on, right_start, right_end)
    levels = F.array_union(_levels(a), _levels(b))

    def spread(df: DataFrame) -> DataFrame:
        df = df.withColumn("_own", F.col("_level")).withColumn("_level", F.explode(F.filter(levels, lambda x: x >= F.col("_own"))))
        return df.withColumn("_cell", F.explode(_cells(F.col("_s"), F.col("_e"), F.col("_level"))))

    a, b = spread(a), _right(spread(b), prefix)
    own = lambda c: F.col(f"{prefix}{c}")
    fit = (F.col("_level") == own("_level")) & (F.col("_cell") == own("_cell")) & (F.col("_level") == F.greatest(F.col("_own"), own("_own")))
    for c in on:
        fit = fit & (F.col(c) == own(c))
    both = (F.col(start) < own(right_end)) & (own(right_start) < F.col(end)) & (F.col("_cell") == _cell(F.greatest(F.col("_s"), own("_s")), F.col("_level")))
    helpers = ("_s", "_e", "_level", "_own", "_cell")
    return a.join(b, fit & both).drop(*helpers, *(prefix + c for c in helpers))


def asof_join(left: DataFrame, right: DataFrame, at: str, on: tuple[str, ...] | list[str] = (), right_at: str | None = None, direction: str = "backward", strict: bool = False, tolerance: float | None = None, prefix: str = "right_", piece_rows: int = 1_000_000) -> DataFrame:
    """Every left row with the right row nearest to it: at or before it (backward), at or after it (forward), or the nearer of both (before, where equal).

    ``strict`` leaves out rows at the same place; ``tolerance`` is a distance in numbers, days or microseconds.
    """
    right_at = right_at or at
    if direction == "nearest":
        back = asof_join(left, right, at, on, right_at, "backward", strict, tolerance, "_b_", piece_rows)
        # the second pass goes over what the first returned, so that repeated rows keep their own matches
        both = asof_join(back, right, at, on, right_at, "forward", strict, tolerance, "_f_", piece_rows)
        behind, ahead = ticks(both, at) - ticks(both, f"_b_{right_at}"), ticks(both, f"_f_{right_at}") - ticks(both, at)
        first = F.col(f"_b_{right_at}").isNotNull() & (F.col(f"_f_{right_at}").isNull() | (behind <= ahead))
        return both.select(*left.columns, *(F.when(first, F.col(f"_b_{c}")).otherwise(F.col(f"_f_{c}")).alias(prefix + c) for c in right.columns))
    if direction not in ("backward", "forward"):
        raise ValueError("direction: backward, forward or nearest")
    sign, on = 1 if direction == "backward" else -1, list(on)
    keys = [f"_k{i}" for i in range(len(on))]
    whole = F.col(at).isNotNull()
    for c in on:
        whole = whole & F.col(c).isNotNull()
    named = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    l_row, r_row = F.struct(*left.columns), F.struct(*right.columns)
    l_kind, r_kind = left.select(l_row.alias("x")).schema["x"].dataType, right.select(r_row.alias("x")).schema["x"].dataType
    # at one place right rows come first, unless they must lie strictly before
    a = left.filter(whole).select(*named, (ticks(left, at) * sign).alias("_t"), F.lit(1).alias("_side"), l_row.alias("_l"), F.lit(None).cast(r_kind).alias("_r"))
    some = F.col(right_at).isNotNull()
    for c in on:
        some = some & F.col(c).isNotNull()
    b = right.filter(some).select(*named, (ticks(right, right_at) * sign).alias("_t"), F.lit(2 if strict else 0).alias("_side"), F.lit(None).cast(l_kind).alias("_l"), r_row.alias("_r"))
    rows = a.unionByName(b)
    pieces = _pieces(rows, keys, piece_rows)
    if pieces is None:
        found = rows.withColumn("_found", F.last("_r", ignorenulls=True).over(_ordered(keys))).filter("_l IS NOT NULL")
    else:
        same = _bin(F.col("_t"), F.col("_width")) == F.col("_bin")
        for k in keys:
            same = same & (F.col(k) == F.col(f"_p{k}"))
        # the widths of hot keys come with them, so only their rows are looked at twice
        hot = pieces.select(*(F.col(k).alias(f"_h{k}") for k in keys), F.col("_width")).distinct()
        is_hot = F.lit(True)
        for k in keys:
            is_hot = is_hot & (F.col(k) == F.col(f"_h{k}"))
        wide = rows.join(hot, is_hot, "left").drop(*(f"_h{k}" for k in keys))
        rows = wide.join(pieces.drop("_width").withColumnsRenamed({k: f"_p{k}" for k in keys}), same, "left").drop(*(f"_p{k}" for k in keys), "_bin").withColumn("_piece", F.coalesce("_piece", F.lit(0)))
        own = rows.withColumn("_found", F.last("_r", ignorenulls=True).over(_ordered([*keys, "_piece"]))).filter("_l IS NOT NULL")
        ends = rows.filter("_width IS NOT NULL").groupBy(*keys, "_piece").agg(F.max(F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).alias("_end"))
        before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(*(F.col(k).alias(f"_c{k}") for k in keys), F.col("_piece").alias("_cp"), F.last("_end", ignorenulls=True).over(before)["_r"].alias("_carried"))
        same = F.col("_piece") == F.col("_cp")
        for k in keys:
            same = same & (F.col(k) == F.col(f"_c{k}"))
        found = own.join(carried, same, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    if tolerance is not None:
        there = found.select("_found.*")
        far = F.abs(F.col("_t") - sign * ticks(there, right_at)) > tolerance
        found = found.select("_l", "_t", "_found", "_found.*").withColumn("_found", F.when(~far, F.col("_found")))
    names = [F.col("_l")[c].alias(c) for c in left.columns] + [F.col("_found")[c].alias(prefix + c) for c in right.columns]
    without = left.filter(~whole).select(*left.columns, *(F.lit(None).cast(f.dataType).alias(prefix + f.name) for f in right.schema))
    return found.select(*names).unionByName(without)


def _ordered(keys: list[str]):
    """Up to the row, in order; right rows of one place by all their columns."""
    return W.partitionBy(*(keys or [F.lit(0)])).orderBy("_t", "_side", "_r").rowsBetween(W.unboundedPreceding, W.currentRow)


def _bin(t: Column, width: Column) -> Column:
    return F.floor(t.cast("double") / width)


def _pieces(rows: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """keys, _width, _bin, _piece of the keys with more than ``most`` rows, none if there is no such key.

    A hot key's range is cut into about 64 bins for each piece, and bins are put together in order until a piece has ``most`` rows; rows of
    one bin stay together, those of one place always do.
    """
    whole = lambda *k: W.partitionBy(*(k or [F.lit(0)]))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).filter(F.col("_n") > most)
    hot = written(counts, "hot-keys")
    if not hot.head(1):
        return None
    span = F.greatest(F.col("_hi").cast("double") - F.col("_lo").cast("double"), F.lit(1e-9))
    width = span / (64 * F.ceil(F.col("_n") / most))
    hot = hot.select(*(F.col(k).alias(f"_h{k}") for k in keys), width.alias("_width"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_h{k}"))
    binned = rows.select(*keys, "_t").join(hot, same).groupBy(*keys, "_width", _bin(F.col("_t"), F.col("_width")).alias("_bin")).agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(whole(*keys).orderBy("_bin")) - F.col("_n")
    return written(binned.select(*keys, "_width", "_bin", F.floor(so_far / most).alias("_piece")), "pieces")
