"""Forecast metrics as aggregates over a long prediction table.

Anything that ranks rows (medians, curves, conformal ranks) first collapses to distinct
values and then uses the sliced prefix sums, so no window ever sees all rows in one task.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import distribution, exact_quantiles, kth_smallest

TOLERANCES = [1, 2, 3, 4, 5, 6, 8, 10]
BIN_WIDTH, BINS = 0.1, 10
CLIP = 1e-9


# --- regression -------------------------------------------------------------------------

def error_columns(y: str = "y", p: str = "p") -> dict[str, Column]:
    error = F.abs(F.col(y) - F.col(p))
    sse = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    sst = F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))
    return {
        "n": F.count(F.lit(1)),
        "mae": F.avg(error),
        "rmse": F.sqrt(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))),
        "r2": F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).otherwise(0.0),
        **{f"within_{t}": F.avg((error <= t).cast("double")) for t in (1, 2, 3, 4)},
    }


def same_group(left: DataFrame, right: DataFrame, group: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables with one row per group; a null group is a group like any other."""
    key = F.struct(F.lit(0).alias("_"), *group)  # nulls inside a struct are equal; no column: one row each
    marked = right.select(key.alias("_group"), *[c for c in right.columns if c not in group])
    return left.withColumn("_group", key).join(marked, "_group", how).drop("_group")


def regression_metrics(df: DataFrame, group: Sequence[str], y: str = "y", p: str = "p",
                       median: bool = True) -> DataFrame:
    """MAE, RMSE, R2, shares within 1-4 and the exact median absolute error per group."""
    main = df.groupBy(*group).agg(*[c.alias(n) for n, c in error_columns(y, p).items()])
    if not median:
        return main
    errors = df.select(*group, F.abs(F.col(y) - F.col(p)).alias("_e"))
    return same_group(main, exact_quantiles(errors, group, "_e", {"median_ae": .5}), group, "left")


def tolerance_table(df: DataFrame, group: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    error = F.abs(F.col(y) - F.col(p))
    exact = F.avg((F.bround(p, 0) == F.col(y)).cast("double"))
    return df.groupBy(*group).agg(
        exact.alias("exact"), *[F.avg((error <= t).cast("double")).alias(f"within_{t}") for t in TOLERANCES])


def baseline_improvement(metrics: DataFrame, candidate: str) -> DataFrame:
    """Gain of the candidate over every other model of a (model, mae) table."""
    own = metrics.filter(F.col("model") == candidate).agg(F.max("mae").alias("m")).scalar()
    return metrics.filter(F.col("model") != candidate).select(
        "model", "mae", (F.col("mae") - own).alias("absolute_improvement"),
        (100 * (F.col("mae") - own) / F.col("mae")).alias("relative_improvement_percent"))


# --- calibration ------------------------------------------------------------------------

def equal_bin(p: Column) -> Column:
    """Bin of ten equal ones over [0, 1]; the last is closed."""
    index = F.lit(0)
    for i in range(1, BINS):
        index = index + F.when(p >= F.lit(i * BIN_WIDTH), 1).otherwise(0)
    return F.when((p >= 0) & (p <= 1), index)


def calibration_error(df: DataFrame, group: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Share-weighted gap between mean outcome and mean probability over the bins."""
    bins = df.withColumn("_bin", equal_bin(F.col(p))).groupBy(*group, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_y"), F.avg(p).alias("_p"))
    gap = F.when(F.col("_bin").isNotNull(), F.col("_n") * F.abs(F.col("_y") - F.col("_p"))).otherwise(0.0)
    return bins.groupBy(*group).agg((F.sum(gap) / F.sum("_n")).alias("ece"))


def reliability_table(df: DataFrame, group: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Mean probability and observed rate per half-open bin of width 0.1; probabilities are clipped as scores are."""
    df = df.withColumn(p, F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP)))
    index = F
    for i in range(BINS):
        low = i * BIN_WIDTH
        index = index.when((F.col(p) >= F.lit(low)) & (F.col(p) < F.lit(low + BIN_WIDTH)), i)
    bins = df.withColumn("bin", index.otherwise(F.lit(None))).groupBy(*group, "bin").agg(
        F.avg(p).alias("predicted"), F.avg(y).alias("observed"), F.count(F.lit(1)).alias("n"))
    # Filtered after the aggregation, so that the score expression is not copied into a predicate.
    return bins.filter(F.col("bin").isNotNull())


# --- classification ---------------------------------------------------------------------

def clipped(probs: str | Column) -> Column:
    """Probabilities clipped away from 0 and 1 and renormalised."""
    safe = F.transform(probs, lambda v: F.least(F.greatest(v, F.lit(CLIP)), F.lit(1 - CLIP)))
    total = F.aggregate(safe, F.lit(0.0), lambda a, v: a + v)
    return F.transform(safe, lambda v: v / total)


def argmax(probs: str | Column) -> Column:
    """Zero-based index of the first largest entry."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("bigint")


def confusion_counts(df: DataFrame, group: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*group, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, group: Sequence[str], classes: Column, y: str = "y", pred: str = "pred") -> DataFrame:
    """All label pairs with zeros kept; ``classes`` is the number of classes of a group."""
    counts = confusion_counts(df, group, y, pred)
    labels = counts.select(*group, classes.alias("_k")).distinct()
    cells = labels.select(*group, F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("y"), "_k") \
        .select(*group, F.col("y").cast("bigint").alias("y"),
                F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("pred"))
    return cells.withColumn("pred", F.col("pred").cast("bigint")).join(counts, [*group, "y", "pred"], "left") \
        .select(*group, "y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def label_scores(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per label present in truth or prediction."""
    sides = counts.select(*group, "n", F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("m")),
        F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("m")))).alias("s"),
        (F.col("y") == F.col("pred")).cast("int").alias("hit"))
    per = sides.groupBy(*group, F.col("s.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.m")).alias("predicted"),
        F.sum(F.col("n") * F.col("s.t") * F.col("hit")).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return per.select(*group, "label", "support", ratio(c("tp"), c("predicted")).alias("precision"),
                      ratio(c("tp"), c("support")).alias("recall"),
                      ratio(2 * c("tp"), c("support") + c("predicted")).alias("f1"))


def classification_metrics(counts: DataFrame, group: Sequence[str], binary: Column) -> DataFrame:
    """Accuracy; precision, recall and F1 (class 1 when binary, else macro); weighted F1."""
    per = label_scores(counts, group)
    take = lambda m: F.when(F.max(binary), F.coalesce(F.max(F.when(F.col("label") == 1, F.col(m))), F.lit(0.0))) \
        .otherwise(F.avg(m))
    averaged = per.groupBy(*group).agg(
        take("precision").alias("precision"), take("recall").alias("recall"), take("f1").alias("f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    hits = counts.groupBy(*group).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return same_group(hits, averaged, group)


def probabilistic_scores(df: DataFrame, group: Sequence[str], y: str = "y", probs: str = "probs") -> DataFrame:
    """Log loss and Brier score on clipped, renormalised probabilities.

    Two classes use the single-probability Brier score, more use the sum over classes.
    """
    ready = df.withColumn("_p", clipped(probs))
    p_true = F.element_at("_p", F.col(y).cast("int") + 1)
    squares = F.aggregate(F.transform("_p", lambda v, i: (v - (i == F.col(y)).cast("double"))
                                      * (v - (i == F.col(y)).cast("double"))), F.lit(0.0), lambda a, v: a + v)
    brier = F.when(F.size("_p") == 2, squares / 2).otherwise(squares)
    return ready.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), (-F.avg(F.log(p_true))).alias("log_loss"), F.avg(brier).alias("brier"))


def ranked_probability_score(df: DataFrame, group: Sequence[str], y: str = "y", probs: str = "probs") -> DataFrame:
    size = F.size(probs)
    cumulative = F.transform(F.sequence(F.lit(1), size), lambda i: F.aggregate(
        F.slice(probs, 1, i), F.lit(0.0), lambda a, v: a + v))
    score = F.aggregate(F.transform(cumulative, lambda v, i: (v - (i >= F.col(y)).cast("double"))
                                    * (v - (i >= F.col(y)).cast("double"))), F.lit(0.0), lambda a, v: a + v)
    return df.groupBy(*group).agg(F.avg(score / (size - 1)).alias("rps"))


# --- ranking curves ---------------------------------------------------------------------

def roc_auc(df: DataFrame, group: Sequence[str], y: str = "y", p: str = "p", slices: int | None = None) -> DataFrame:
    """Exact area under the ROC curve with mid-ranks; null when a class is missing."""
    d = distribution(df, group, p, {"pos": F.col(y).cast("bigint")}, slices)
    neg, neg_before = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    pairs = F.sum(F.col("pos") * (neg_before.cast("double") + neg / 2))
    positives = F.max("pos_total")
    negatives = F.max("n_total") - positives
    return d.groupBy(*group).agg(
        F.when((positives > 0) & (negatives > 0), pairs / (positives.cast("double") * negatives)).alias("roc_auc"))


def pr_curve(df: DataFrame, group: Sequence[str], y: str = "y", p: str = "p", slices: int | None = None) -> DataFrame:
    """One point per distinct score, from the highest down: hits, flagged, precision, recall."""
    d = distribution(df, group, p, {"pos": F.col(y).cast("bigint")}, slices, descending=True)
    hits, flagged = F.col("pos_before") + F.col("pos"), F.col("n_before") + F.col("n")
    return d.select(*group, F.col(p).alias("threshold"), "pos", F.col("pos_total").alias("positives"),
                    hits.alias("hits"), flagged.alias("flagged"), (hits / flagged).alias("precision"),
                    F.when(F.col("pos_total") > 0, hits / F.col("pos_total")).alias("recall"))


def pr_auc(df: DataFrame, group: Sequence[str], y: str = "y", p: str = "p", slices: int | None = None) -> DataFrame:
    """Average precision: recall steps weighted by precision; null without positives."""
    curve = pr_curve(df, group, y, p, slices)
    positives = F.max("positives")
    area = F.sum(F.col("pos") * F.col("precision")) / positives
    return curve.groupBy(*group).agg(F.when(positives > 0, area).alias("pr_auc"))


def best_f1_threshold(df: DataFrame, group: Sequence[str], y: str = "y", p: str = "p", slices: int | None = None) -> DataFrame:
    """Lowest threshold with the largest F1; null without positives."""
    curve = pr_curve(df, group, y, p, slices).withColumn(
        "f1", 2 * F.col("hits") / (F.col("flagged") + F.col("positives")))
    best = F.max(F.struct("f1", -F.col("threshold"), "flagged", "precision", "recall"))
    got = curve.groupBy(*group).agg(best.alias("b"), F.max("positives").alias("_pos"))
    keep = lambda col: F.when(F.col("_pos") > 0, col)
    return got.select(*group, keep(-F.col("b.col2")).alias("threshold"), keep(F.col("b.flagged")).alias("flagged"),
                      keep(F.col("b.precision")).alias("precision"), keep(F.col("b.recall")).alias("recall"),
                      keep(F.col("b.f1")).alias("f1"))


def at_threshold(df: DataFrame, thresholds: DataFrame, group: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall and F1 of ``p >= threshold``, the thresholds (one per group) chosen on other rows."""
    hit = (F.col(p) >= F.col("threshold")).cast("bigint")
    per = same_group(df, thresholds.select(*group, "threshold"), group).groupBy(*group, "threshold").agg(
        F.sum(hit).alias("flagged"), F.sum(hit * F.col(y)).alias("_hits"), F.sum(y).alias("_pos"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return per.select(*group, "threshold", "flagged", ratio(c("_hits"), c("flagged")).alias("precision"),
                      ratio(c("_hits"), c("_pos")).alias("recall"), ratio(2 * c("_hits"), c("flagged") + c("_pos")).alias("f1"))


# --- conformal intervals ----------------------------------------------------------------

def conformal_rank(alpha: float) -> Column:
    return F.ceil((F.col("n_total") + 1) * F.lit(1 - alpha))


def conformal_radius(df: DataFrame, group: Sequence[str], alpha: float = .2, y: str = "y", p: str = "p",
                     slices: int | None = None) -> DataFrame:
    """k-th smallest absolute residual, k = ceil((n + 1)(1 - alpha)); the job fails when k > n."""
    errors = df.select(*group, F.abs(F.col(y) - F.col(p)).alias("_e"))
    enough = F.when(conformal_rank(alpha) > F.col("n_total"),
                    F.raise_error(F.lit("too few calibration rows for a finite conformal interval"))) \
        .otherwise(conformal_rank(alpha))
    return kth_smallest(errors, group, "_e", enough, slices).withColumnRenamed("value", "radius")


def conformal_block_radius(df: DataFrame, group: Sequence[str], block: str = "match_id", alpha: float = .2,
                           y: str = "y", p: str = "p") -> DataFrame:
    """The same rank over each block's largest residual: covers a whole match at once."""
    worst = df.groupBy(*group, block).agg(F.max(F.abs(F.col(y) - F.col(p))).alias("_worst"))
    zero = worst.withColumn("_zero", F.lit(0.0))
    return conformal_radius(zero, group, alpha, "_worst", "_zero")


def interval_columns(p: Column, radius: Column) -> tuple[Column, Column]:
    """Bounds rounded outward to integers, never below zero."""
    return F.greatest(F.lit(0), F.floor(p - radius)), F.ceil(p + radius)


def interval_coverage(df: DataFrame, group: Sequence[str], lower: str, upper: str, target: float,
                      y: str = "y", block: str = "match_id") -> DataFrame:
    """Coverage, its error, width, and the share of blocks covered completely."""
    marked = df.select(*group, block, ((F.col(y) >= F.col(lower)) & (F.col(y) <= F.col(upper))).alias("_in"),
                       (F.col(upper) - F.col(lower)).cast("double").alias("_width"))
    blocks = marked.groupBy(*group, block).agg(
        F.bool_and("_in").alias("_all"), F.sum(F.col("_in").cast("bigint")).alias("_hits"),
        F.count(F.lit(1)).alias("_n"), F.sum("_width").alias("_w"))
    main = blocks.groupBy(*group).agg(
        F.sum("_n").alias("n"), (F.sum("_hits") / F.sum("_n")).alias("coverage"),
        (F.sum("_hits") / F.sum("_n") - F.lit(target)).alias("coverage_error"),
        (F.sum("_w") / F.sum("_n")).alias("mean_width"),
        F.avg(F.col("_all").cast("double")).alias("simultaneous_coverage"))
    return same_group(main, exact_quantiles(marked, group, "_width", {"median_width": .5}), group)


# --- comparisons ------------------------------------------------------------------------

def paired_test(df: DataFrame, group: Sequence[str], reference: str, challenger: str, y: str = "y",
                sigmas: float = 2.0) -> DataFrame:
    """Mean reduction of absolute error on the same rows, its standard error and z."""
    gain = F.abs(F.col(y) - F.col(reference)) - F.abs(F.col(y) - F.col(challenger))
    base = df.select(*group, gain.alias("_d")).groupBy(*group).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("mae_improvement"), F.stddev_samp("_d").alias("_s"))
    se = F.col("_s") / F.sqrt("n")
    return base.select(*group, "n", "mae_improvement", se.alias("standard_error"),
                       F.when(se > 0, F.col("mae_improvement") / se).otherwise(0.0).alias("z"),
                       F.coalesce(F.col("mae_improvement") > sigmas * se, F.lit(False)).cast("bigint").alias("significant"))


def bootstrap_ci(df: DataFrame, value: Column, draws: int = 5000, seed: int = 20260907) -> DataFrame:
    """Percentile interval of a mean under Poisson(1) resampling.

    Equal values are combined first: the summed weight of c equal rows is Poisson(c). Each
    task then adds its weighted sums up and sends one (draw, sum, weight) vector.
    """
    import numpy as np
    import pandas as pd

    def partial(batches):
        total, weight = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            v, n = batch["v"].to_numpy(), batch["n"].to_numpy()
            # Each distinct value has a generator of its own, so draws don't depend on where a row is.
            for value, bits, times in zip(v, v.view(np.uint64).tolist(), n):
                drawn = np.random.default_rng([seed, bits]).poisson(times, draws)
                total += drawn * value
                weight += drawn
        yield pd.DataFrame({"draw": np.arange(draws), "total": total, "weight": weight})

    values = df.groupBy(value.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    sums = values.mapInPandas(partial, "draw int, total double, weight double")
    means = sums.groupBy("draw").agg((F.sum("total") / F.sum("weight")).alias("mean"))
    # One row per draw from here on, so the exact percentile buffer is bounded by ``draws``.
    return means.agg(
        F.percentile("mean", F.lit(.025)).alias("low"), F.percentile("mean", F.lit(.975)).alias("high"),
        F.avg((F.col("mean") > 0).cast("double")).alias("probability_better"), F.stddev_samp("mean").alias("bootstrap_se"),
        F.count(F.lit(1)).alias("draws"))


def segment_rows(df: DataFrame, segments: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per (row, segment it belongs to), in a single pass."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(n)) for n, cond in segments.items()]))
    return df.select(*keep, F.explode(names).alias("segment"))


def segment_metrics(df: DataFrame, segments: Mapping[str, Column], y: str = "y", p: str = "p", least: int = 2) -> DataFrame:
    """The regression block and the two means of each segment with at least ``least`` rows."""
    rows = segment_rows(df, segments, [y, p])
    return rows.groupBy("segment").agg(
        *[c.alias(n) for n, c in error_columns(y, p).items()],
        F.avg(y).alias("mean_actual"), F.avg(p).alias("mean_predicted")).filter(F.col("n") >= least)


def worst_n(df: DataFrame, n: int, order: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """The n largest absolute errors; ties resolved by ``order``."""
    return df.withColumn("absolute_error", F.abs(F.col(y) - F.col(p))) \
        .orderBy(F.desc("absolute_error"), *order).limit(n)


def error_lift(df: DataFrame, worst: DataFrame, conditions: Mapping[str, Column], error: str = "absolute_error") -> DataFrame:
    """How much more often each condition holds among the worst rows, and its share of error."""
    def table(rows: DataFrame) -> DataFrame:
        tests = F.array(*[F.struct(F.lit(n).alias("condition"), F.coalesce(c, F.lit(False)).alias("holds"))
                          for n, c in conditions.items()])
        flat = rows.select(error, F.explode(tests).alias("t")).select(error, "t.*")
        hit = F.col("holds")
        return flat.groupBy("condition").agg(
            F.sum(hit.cast("bigint")).alias("n"), F.avg(hit.cast("double")).alias("share"),
            F.avg(F.when(hit, F.col(error))).alias("mae_when_true"),
            F.avg(F.when(~hit, F.col(error))).alias("mae_when_false"),
            (F.sum(F.when(hit, F.col(error)).otherwise(0.0)) / F.sum(error)).alias("share_of_total_error"))

    everywhere = table(df)
    inside = table(worst).select("condition", F.col("share").alias("share_of_worst"))
    return everywhere.join(F.broadcast(inside), "condition").withColumn(
        "lift", F.when(F.col("share") > 0, F.col("share_of_worst") / F.col("share")))


def worst_summary(df: DataFrame, worst: DataFrame, error: str = "absolute_error", y: str = "y", p: str = "p") -> DataFrame:
    """Size, mean error, share of all error and share of forecasts that were too low among the worst rows (one row)."""
    total = df.agg(F.sum(error).alias("t")).scalar()
    return worst.agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("worst_mae"), F.sum(error).alias("_e"),
                     F.avg((F.col(p) < F.col(y)).cast("double")).alias("under_prediction_share")).select(
        "n", "worst_mae", (F.col("_e") / total).alias("share_of_total_error"), "under_prediction_share")


def gain_attribution(df: DataFrame, group: str, reference: str, challenger: str, y: str = "y") -> DataFrame:
    """Share of the total improvement that each group contributes."""
    gain = F.abs(F.col(y) - F.col(reference)) - F.abs(F.col(y) - F.col(challenger))
    per = df.groupBy(group).agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("n"))
    total = F.sum("gain").over(W.partitionBy(F.lit(0)))          # one row per group value
    return per.select(group, "n", "gain", F.when(total != 0, F.col("gain") / total).alias("share"))


def class_support(df: DataFrame, group: Sequence[str], y: str = "y") -> DataFrame:
    counts = df.groupBy(*group, F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", (F.col("n") / F.sum("n").over(W.partitionBy(*group))).alias("rate"))
