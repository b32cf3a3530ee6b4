"""Metrics of scored tables ``y`` (1: phishing), ``p``.

Everything that depends on order works on the histogram of distinct scores (``score_histogram``), and running sums over it
go through ``prefix_sum``, which never puts all scores in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
#: Lower edges of ten calibration bins, as floating-point steps give them.
EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def score_histogram(df: DataFrame, score: str = "p") -> DataFrame:
    """``p, pos, neg``: rows of both classes at each distinct score."""
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("p")).agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def prefix_sum(df: DataFrame, order: str, values: tuple[str, ...], descending: bool = True, buckets: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``cum_<v>``: running sums in the order of ``order`` (a number), the row itself included, over all rows or
    those of each ``by``.

    Rows are cut into buckets between approximate quantiles of the order column, so outliers do not crowd one; sums run
    inside a bucket and over the buckets' totals."""
    edges = df.groupBy(*by).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 4 * buckets).alias("_e"))
    placed = (df.join(edges, list(by)) if by else df.join(F.broadcast(edges))).withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col(order))))
    turn = F.desc if descending else F.asc
    totals = placed.groupBy(*by, "_b").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))  # at most ``buckets`` rows for each ``by``
    before = Window.partitionBy(*by).orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_b", *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_s_{v}") for v in values))
    inside = Window.partitionBy(*by, "_b").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(totals if by else F.broadcast(totals), [*by, "_b"])
    return joined.select(*df.columns, *((F.sum(v).over(inside) + F.col(f"_s_{v}")).alias(f"cum_{v}") for v in values))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates of a confusion matrix: 0 where a rate's denominator is 0, null for the false-positive rate."""
    n = tp + fp + fn + tn
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "accuracy": zero(tp + tn, n),
        "precision": zero(tp, tp + fp),
        "recall": zero(tp, tp + fn),
        "f1": zero(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": F.when(fp + tn > 0, fp / (fp + tn)),
    }


def counts(flag: Column, y: Column | None = None) -> dict[str, Column]:
    y = F.col("y") if y is None else y
    return {"tp": F.count_if(flag & (y == 1)), "fp": F.count_if(flag & (y == 0)), "fn": F.count_if(~flag & (y == 1)), "tn": F.count_if(~flag & (y == 0))}


def _with_rates(df: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("tp", "fp", "fn", "tn")]
    return df.withColumns(rates(*c) | {"n": sum(c[1:], c[0])})


def binary_metrics(df: DataFrame, threshold: float = 0.5, positive: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion matrix and rates of ``p >= threshold``; ``positive=0`` takes legitimate rows as positive."""
    flag = F.col("p") >= threshold
    y = F.col("y") if positive == 1 else 1 - F.col("y")
    return _with_rates(df.groupBy(*by).agg(*(c.alias(k) for k, c in counts(flag if positive == 1 else ~flag, y).items())))


def roc_auc(df: DataFrame, by: str | None = None) -> DataFrame:
    """Tie-aware area under the curve; null with one class or one score."""
    h = prefix_sum(score_histogram(df), "p", ("pos", "neg"))
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2))
    total = F.sum("pos") * F.sum("neg")
    return h.agg(F.when((total > 0) & (F.count("*") > 1), area / total).alias("roc_auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def average_precision(df: DataFrame) -> DataFrame:
    h = prefix_sum(score_histogram(df), "p", ("pos", "neg"))
    return h.agg((F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / F.sum("pos")).alias("average_precision"))


def threshold_max_fpr(df: DataFrame, cap: float) -> DataFrame:
    """``cap, allowed, boundary``: rows are flagged if ``p > boundary``; null boundary: all rows may be flagged.

    The boundary is the score of the (allowed + 1)-th highest negative, ``allowed`` being the floor of the cap's share."""
    h = prefix_sum(score_histogram(df), "p", ("neg",))
    n = df.agg(F.floor(F.lit(cap) * F.sum(1 - F.col("y"))).cast("long").alias("allowed"))
    return h.where("neg > 0").join(F.broadcast(n)).groupBy("allowed").agg(F.max(F.when(F.col("cum_neg") > F.col("allowed"), F.col("p"))).alias("boundary")).select(F.lit(cap).alias("cap"), "allowed", "boundary")


def threshold_fbeta(df: DataFrame, beta: float) -> DataFrame:
    """``beta, threshold, fbeta``: the observed score that gives the best F-beta, the highest of equals."""
    h = prefix_sum(score_histogram(df), "p", ("pos", "neg")).join(F.broadcast(df.agg(F.sum("y").alias("_p"))))
    b2 = beta * beta
    f = (1 + b2) * F.col("cum_pos") / (b2 * F.col("_p") + F.col("cum_pos") + F.col("cum_neg"))
    best = h.withColumn("f", F.round(f, 12)).agg(F.max(F.struct("f", "p")).alias("m"))
    return best.select(F.lit(float(beta)).alias("beta"), F.col("m.p").alias("threshold"), F.col("m.f").alias("fbeta"))


def threshold_precision(df: DataFrame, flag: float, target: float = 0.95) -> DataFrame:
    """The lowest observed score of at least ``flag`` from which on the precision reaches the target; null if none."""
    h = prefix_sum(score_histogram(df), "p", ("pos", "neg"))
    return h.where(F.col("p") >= flag).agg(F.min(F.when(F.col("cum_pos") >= target * (F.col("cum_pos") + F.col("cum_neg")), F.col("p"))).alias("threshold"))


def threshold_table(df: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Confusion matrix, rates and F2 at each threshold of a short grid, from one pass over the histogram."""
    h = score_histogram(df)
    at = h.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    flag = F.col("p") >= F.col("threshold")
    out = at.groupBy("threshold").agg(*(F.sum(F.when(f, F.col(c)).otherwise(0)).alias(k) for k, f, c in (("tp", flag, "pos"), ("fp", flag, "neg"), ("fn", ~flag, "pos"), ("tn", ~flag, "neg"))))
    f2 = F.when(F.col("tp") > 0, 5 * F.col("tp") / (4 * (F.col("tp") + F.col("fn")) + F.col("tp") + F.col("fp"))).otherwise(0.0)
    return _with_rates(out).withColumn("f2", f2)


def threshold_criteria(df: DataFrame) -> DataFrame:
    """``criterion, boundary, strict`` and metrics of seven ways to set the threshold; ``strict``: flagged above the boundary."""
    rows = [df.limit(1).select(F.lit("fixed_0.5").alias("criterion"), F.lit(0.5).alias("boundary"), F.lit(False).alias("strict"))]
    for cap in (0.01, 0.02, 0.05, 0.1):
        rows.append(threshold_max_fpr(df, cap).select(F.lit(f"fpr_le_{cap:g}").alias("criterion"), "boundary", F.lit(True)))
    for beta in (1.0, 2.0):
        rows.append(threshold_fbeta(df, beta).select(F.lit(f"max_f{beta:g}").alias("criterion"), "threshold", F.lit(False)))
    limits = reduce(DataFrame.union, rows)
    flag = F.col("boundary").isNull() | F.when(F.col("strict"), F.col("p") > F.col("boundary")).otherwise(F.col("p") >= F.col("boundary"))
    met = score_histogram(df).join(F.broadcast(limits)).withColumn("flag", flag)
    out = met.groupBy("criterion", "boundary", "strict").agg(*(F.sum(F.when(f, F.col(c)).otherwise(0)).alias(k) for k, f, c in (("tp", F.col("flag"), "pos"), ("fp", F.col("flag"), "neg"), ("fn", ~F.col("flag"), "pos"), ("tn", ~F.col("flag"), "neg"))))
    return _with_rates(out)


def subset_rates(df: DataFrame, flag: Column, subset: str) -> DataFrame:
    """Flagged share of each class in each value of ``subset``."""
    return df.groupBy(subset).agg(F.count("*").alias("n"), F.avg(F.when(F.col("y") == 1, flag.cast("double"))).alias("recall"), F.avg(F.when(F.col("y") == 0, flag.cast("double"))).alias("false_positive_rate"))


def fpr_guard(df: DataFrame, flag: Column, subset: Column, factor: float = 2.0) -> DataFrame:
    """False-positive rate of a subset of the legitimate rows against all of them, and whether it is within the factor."""
    clean = F.col("y") == 0
    out = df.agg(F.avg(F.when(clean, flag.cast("double"))).alias("overall"), F.avg(F.when(clean & subset, flag.cast("double"))).alias("subset"))
    return out.select("overall", "subset", (F.col("subset") / F.col("overall")).alias("ratio"), F.coalesce(F.col("subset") <= factor * F.col("overall"), F.lit(True)).alias("passes"))


def percentiles(df: DataFrame, columns: tuple[str, ...], points: tuple[float, ...] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """``feature`` and its exact percentiles, interpolated linearly (nulls left out); ranks come from running counts of the distinct
    values of each feature."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "feature", "v").where(F.col("v").isNotNull())
    h = prefix_sum(long.groupBy("feature", "v").agg(F.count("*").alias("c")), "v", ("c",), descending=False, by=("feature",))
    n = h.groupBy("feature").agg(F.sum("c").alias("n"))
    at = lambda rank: F.min(F.when(F.col("cum_c") > rank, F.col("v")))  # the value at a rank counted from 0
    cells = []
    for x in points:
        rank = F.lit(float(x)) * (F.col("n") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        cells.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"p{round(100 * x):d}"))
    return h.join(n, "feature").groupBy("feature").agg(*cells)


def calibration(df: DataFrame) -> DataFrame:
    """``bin, n, mean_predicted, observed_rate, ece_part, brier_part``; empty bins are left out, the parts add up to ECE and Brier."""
    b = sum(((F.col("p") >= e).cast("int") for e in EDGES), F.lit(0))
    grouped = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_rate"), F.sum((F.col("p") - F.col("y")) ** 2).alias("se"))
    total = F.broadcast(df.agg(F.count("*").alias("rows")))
    return grouped.join(total).select("bin", "n", "mean_predicted", "observed_rate", (F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed_rate")) / F.col("rows")).alias("ece_part"), (F.col("se") / F.col("rows")).alias("brier_part"))


def class_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of both classes, their plain and their weighted means."""
    one = lambda positive, name: binary_metrics(df, threshold, positive).select(F.lit(name).alias("name"), "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))
    each = one(0, "legitimate").union(one(1, "phishing"))
    s = F.sum("support")
    mean = lambda name, f: each.agg(*(f(c).alias(c) for c in ("precision", "recall", "f1")), s.alias("support")).select(F.lit(name).alias("name"), "precision", "recall", "f1", "support")
    return each.union(mean("macro", F.avg)).union(mean("weighted", lambda c: F.sum(F.col(c) * F.col("support")) / s))


def outcome(flag: Column) -> Column:
    y = F.col("y") == 1
    return F.when(y & flag, "TP").when(y, "FN").when(flag, "FP").otherwise("TN")


def top_parents(df: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent ``parent`` values of each ``outcome``, ties by name."""
    w = Window.partitionBy("outcome").orderBy(F.desc("rows"), "parent")
    return df.groupBy("outcome", "parent").agg(F.count("*").alias("rows")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def degenerate_features(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Constant columns, and an URLLength that is DomainLength plus a constant: ``feature, reason, value``."""
    cells = [F.struct(F.lit(c).alias("feature"), F.lit("constant").alias("reason"), F.min(F.col(c).cast("double")).alias("value"), (F.min(c) == F.max(c)).alias("hit")) for c in columns]
    gap = F.col("URLLength") - F.col("DomainLength")
    cells.append(F.struct(F.lit("URLLength").alias("feature"), F.lit("DomainLength plus a constant").alias("reason"), F.min(gap.cast("double")).alias("value"), (F.min(gap) == F.max(gap)).alias("hit")))
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a")).where("hit").drop("hit")


def correlated_pairs(df: DataFrame, columns: tuple[str, ...], least: float = 0.9) -> DataFrame:
    """``a, b, r`` of column pairs with an absolute correlation of at least ``least``; constant columns have none."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c")).where(F.abs("r") >= least)


def label_ambiguity(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """How far equal vectors carry both labels: rows, rows in mixed vectors, distinct vectors, least error, greatest recall."""
    by = df.groupBy(*columns).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    mixed = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return by.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(mixed, F.col("n"))), F.lit(0)).alias("rows_in_mixed_vectors"), F.count("*").alias("distinct_vectors"),
        (F.sum(F.least("pos", F.col("n") - F.col("pos"))) / F.sum("n")).alias("minimum_error"),
        (1 - F.coalesce(F.sum(F.when(2 * F.col("pos") <= F.col("n"), F.col("pos"))), F.lit(0)) / F.sum("pos")).alias("maximum_recall"),
    )


def latency_summary(df: DataFrame, column: str = "processing_ms") -> DataFrame:
    """``n, mean, median, p95`` (the row at the rounded rank), ``min, max``; ranks come from running counts of distinct values."""
    h = prefix_sum(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c")), "v", ("c",), descending=False)
    whole = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    at = lambda rank: F.min(F.when(F.col("cum_c") >= rank, F.col("v")))  # the value at a rank counted from 1
    half = (F.col("n") + 1) / 2
    ranks = h.join(F.broadcast(whole.select("n"))).agg(((at(F.floor(half)) + at(F.ceil(half))) / 2).alias("median"), at(F.greatest(F.rint(0.95 * F.col("n")), F.lit(1.0))).alias("p95"))
    return whole.join(F.broadcast(ranks)).select("n", "mean", "median", "min", "max", "p95")


def majority_vote(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df`` with the votes of label columns (0: phishing), the majority (ties legitimate), its share and its name."""
    votes = sum(((F.col(c) == 0).cast("int") for c in columns), F.lit(0))
    k = len(columns)
    final = F.when(votes > k - votes, 0).otherwise(1)
    return df.withColumns({"phishing_votes": votes, "prediction": final, "confidence": F.greatest(votes, k - votes) / k, "prediction_text": F.when(final == 0, "phishing").otherwise("legitimate")})


def select_model(results: DataFrame, incumbent: str) -> DataFrame:
    """The candidate of the largest mean gain among those whose interval lies above 0, else the incumbent."""
    best = results.where("ci_lo > 0").agg(F.max_by("model", "mean").alias("best"))
    return best.select(F.coalesce("best", F.lit(incumbent)).alias("model"), F.col("best").isNotNull().alias("replaced"))


def linear_percentile(values, share: float) -> float:
    """The percentile of sorted values, between two of them on a line."""
    at = share * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return float(values[low] + (values[high] - values[low]) * (at - low))
