"""Scores of classifiers, repairs and generated SQL as aggregates.

``predictions`` has one row for each case: y_true, y_pred and, where asked for,
confidence.  Class-level tables are built from one confusion aggregate
(classes squared rows), so a corpus is read and shuffled once, as partial sums.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..labels import labels_dim


def class_histogram(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n for every class, zero where it does not occur."""
    dim = labels_dim(rows.sparkSession).select(F.col("label").alias("_l"))
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return dim.join(n, F.col("_l") == n["label"], "left").select(F.col("_l").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def class_by_split(rows: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """label, one count for each split, total; and a row TOTAL."""
    counted = [F.count(F.when(F.col("split") == s, 1)).alias(s) for s in splits]
    t = rows.rollup("label").agg(*counted, F.count("*").alias("total"), F.grouping("label").alias("_g"))
    return t.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("label")).alias("label"), *splits, "total")


def confusion(predictions: DataFrame) -> DataFrame:
    """y_true, y_pred, n for every pair of classes, zero cells included."""
    dim = labels_dim(predictions.sparkSession).select("label")
    cells = dim.select(F.col("label").alias("_t")).join(dim.select(F.col("label").alias("_p")), F.lit(True))
    n = predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return cells.join(n, (F.col("_t") == F.col("y_true")) & (F.col("_p") == F.col("y_pred")), "left").select(
        F.col("_t").alias("y_true"), F.col("_p").alias("y_pred"), F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_normalised(predictions: DataFrame) -> DataFrame:
    """The confusion table with each cell as a share of its true class."""
    row = F.greatest(F.sum("n").over(W.partitionBy("y_true")), F.lit(1))
    return confusion(predictions).withColumn("share", F.round(F.col("n") / row, 6))


def per_class(predictions: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; a division by zero counts as 0."""
    c = confusion(predictions)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    true = c.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = c.groupBy(F.col("y_pred").alias("_p")).agg(F.sum("n").alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = true.join(said, F.col("label") == F.col("_p"))
    return t.select(
        "label", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support", "tp",
    )


def class_report(predictions: DataFrame) -> DataFrame:
    return per_class(predictions).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def macro_scores(predictions: DataFrame) -> DataFrame:
    """accuracy and unweighted means over all classes, in one row."""
    means = [F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    return per_class(predictions).agg(F.round(F.coalesce(F.sum("tp") / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0)), 6).alias("accuracy"), *means)


def accuracy_by(predictions: DataFrame, *keys: str) -> DataFrame:
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def _bins(predictions: DataFrame, bins: int) -> DataFrame:
    """bin (1 to bins, intervals open below), n, mean correctness and confidence; confidence 0 is in none."""
    b = F.least(F.ceil(F.col("confidence") * bins), F.lit(bins)).cast("int")
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    return predictions.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.avg(hit).alias("correct"), F.avg("confidence").alias("confidence"))


def calibration_error(predictions: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error, in one row."""
    gap = F.when(F.col("bin") >= 1, F.col("n") * F.abs(F.col("correct") - F.col("confidence"))).otherwise(0.0)
    return _bins(predictions, bins).agg(F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"))


def reliability(predictions: DataFrame, bins: int = 10) -> DataFrame:
    return _bins(predictions, bins).filter("bin >= 1").select("bin", "n", F.round("correct", 6).alias("correct"), F.round("confidence", 6).alias("confidence"))


def ovr_auc(scores: DataFrame) -> DataFrame:
    """One-vs-rest area under the curve for each class, from rows (label, positive, score).

    Ties share their average rank.  Ranks need no row-by-row window: equal scores are
    counted first, and only their counts are summed up in order.
    """
    n = scores.groupBy("label", "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(W.partitionBy("label").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = n.withColumn("w", F.col("p") * (below + (F.col("n") - F.col("p")) / 2))
    p, q = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return wins.groupBy("label").agg(F.round(F.when((p > 0) & (q > 0), F.sum("w") / (p * q)), 6).alias("auc"))


def bootstrap_intervals(predictions: DataFrame, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 percentiles of accuracy over Poisson resamples of the confusion cells.

    A resample of a corpus is a draw of each cell's count: Poisson(n) by a normal
    approximation for counts above 30 and by inversion below; rows are classes squared x resamples.
    """
    cells = confusion(predictions).filter("n > 0")
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "r", "y_true", "y_pred"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * F.pi() * u("b"))
    d = cells.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)),
        F.struct(F.exp(-F.col("n").cast("double")).alias("t"), F.exp(-F.col("n").cast("double")).alias("c"), F.lit(0).alias("k")),
        lambda s, i: F.struct((s["t"] * F.col("n") / i).alias("t"), (s["c"] + s["t"] * F.col("n") / i).alias("c"), (s["k"] + F.when(F.col("_u") > s["c"], 1).otherwise(0)).alias("k")),
    )["k"]
    d = d.withColumn("_u", u("c")).withColumn("m", F.when(F.col("n") > 30, F.greatest(F.round(F.col("n") + normal * F.sqrt("n")), F.lit(0.0))).otherwise(step.cast("double")))
    acc = d.groupBy("r").agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("m")).otherwise(0.0)) / F.sum("m")).alias("a"))
    return acc.agg(F.round(F.percentile("a", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("a", F.lit(0.975)), 6).alias("high"))


def mcnemar_counts(pairs: DataFrame) -> DataFrame:
    """only_a, only_b from rows (correct_a, correct_b)."""
    return pairs.agg(F.count_if(F.col("correct_a") & ~F.col("correct_b")).alias("only_a"), F.count_if(~F.col("correct_a") & F.col("correct_b")).alias("only_b"))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Two-sided exact p-value; whole numbers throughout, since 2 ** n exceeds a double."""
    n, k = only_a + only_b, min(only_a, only_b)
    return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def rates(rows: DataFrame, keys: tuple[str, ...], flags: dict[str, Column], latency: str | None = None) -> DataFrame:
    """Shares of true flags at three levels: all, by the first key, by both keys; with mean and 95th percentile latency."""
    aggs = [F.count("*").alias("n"), *(F.round(F.avg(f.cast("int")), 6).alias(k) for k, f in flags.items())]
    if latency:
        aggs += [F.round(F.avg(latency), 6).alias("mean_latency"), F.round(F.percentile(latency, F.lit(0.95)), 6).alias("p95_latency")]
    a, b = keys
    t = rows.groupingSets([[], [a], [a, b]], a, b).agg(*aggs, F.grouping_id().alias("_g"))
    return t.select(F.when(F.col("_g") == 3, "ALL").otherwise(F.col(a)).alias(a), F.when(F.col("_g") == 0, F.col(b)).alias(b), *[c for c in t.columns if c not in (a, b, "_g")])


def latency_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, exact 95th percentile with linear interpolation."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"))


def first_examples(rows: DataFrame, key: str, text: str, order: str, most: int = 3) -> DataFrame:
    """The first ``most`` distinct texts of each key, by their first appearance.

    Distinct texts are found by a partial aggregate; each partition then keeps ``most``
    before the window, which Spark does for row_number <= constant.
    """
    first = rows.groupBy(key, text).agg(F.min(order).alias("first_seen"))
    rn = F.row_number().over(W.partitionBy(key).orderBy("first_seen"))
    return first.withColumn("rn", rn).filter(F.col("rn") <= most).select(key, "rn", text, "first_seen")


def weakest(groups: DataFrame, score: str, most: int, *tie: str) -> DataFrame:
    return groups.orderBy(F.col(score).asc(), *tie).limit(most)


def stage_rates(rows: DataFrame) -> DataFrame:
    """Valid and executable shares of raw, selected and final candidates, and counts by status."""
    shares = [F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in ("raw_valid", "selected_valid", "final_valid", "raw_exec", "final_exec")]
    return rows.groupBy("status").agg(F.count("*").alias("n"), *shares, F.round(F.avg("ms"), 6).alias("mean_ms"))


def focal_loss(p: Column, gamma: float = 2.0) -> Column:
    """Loss of a case from the probability of its true class; gamma 0 is cross entropy."""
    p = F.greatest(p, F.lit(1e-12))
    return -F.pow(1 - p, F.lit(gamma)) * F.log(p)


def permission_accuracy(rows: DataFrame) -> DataFrame:
    """n and the share of rows whose verdict and label agree on PERMISSION_DENIED."""
    same = (F.col("error_class") == "PERMISSION_DENIED") == (F.col("label") == "PERMISSION_DENIED")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("int")), 6).alias("accuracy"))


def audit(rows: DataFrame) -> DataFrame:
    """error_class, n, share of all rows: how many correct queries the analyzer lets pass, and what it says of the rest."""
    n = rows.groupBy("error_class").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def first_spellings(rows: DataFrame, name: str, order: str) -> DataFrame:
    """name and its first spelling, whatever the case."""
    return rows.groupBy(F.lower(name).alias("name")).agg(F.min_by(name, F.struct(order, name)).alias("spelling"))
