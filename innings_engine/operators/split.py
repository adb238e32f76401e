"""Time-ordered partitions. All rules work on the table of dates (one row per day)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PARTITIONS = ["train", "validation", "refit_extra", "probability_calibration", "interval_calibration", "test"]
FITTED = ["train", "validation", "refit_extra"]
STRATEGIES = ["legacy", "recent", "refit", "refit_plus"]
MIN_SEASONS = 5
MIN_DATES = 8


def date_table(df: DataFrame) -> DataFrame:
    """season, date, position of the date in its season and the season's number of dates."""
    days = df.select("season", "date").distinct()
    season = W.partitionBy("season")
    return days.select(
        "season", "date", (F.row_number().over(season.orderBy("date")) - 1).alias("day_index"),
        F.count(F.lit(1)).over(season).alias("season_days"),
        F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc("season"))).alias("season_back"))


def _before(fraction: float) -> Column:
    return F.col("day_index") < F.floor(F.col("season_days") * F.lit(fraction))


def chrono_labels(df: DataFrame) -> DataFrame:
    """(date, partition): last season test, the one before calibrates, then validation, then train."""
    days = date_table(df)
    seasons = F.max("season_back").over(W.partitionBy(F.lit(0)))
    back = F.col("season_back")
    label = (F.when(F.col("_seasons") < MIN_SEASONS,
                    F.raise_error(F.lit("at least five seasons are needed for independent partitions")))
             .when(back == 1, "test")
             .when((back == 2) & _before(.50), "refit_extra")
             .when((back == 2) & _before(.75), "probability_calibration")
             .when(back == 2, "interval_calibration")
             .when(back == 3, "validation")
             .otherwise("train"))
    return days.withColumn("_seasons", seasons).select("date", label.alias("partition"))


def with_partition(df: DataFrame) -> DataFrame:
    """Label rows; the label table has one row per day, so its broadcast is bounded by time."""
    return df.join(F.broadcast(chrono_labels(df)), "date")


def strategy_label(strategy: str, test_season: Column) -> Column:
    """Partition of a date under one walk-forward strategy; null when unused."""
    season = F.col("season")
    gap = test_season - season
    if strategy == "recent":
        rule = (F.when(gap == 0, "test").when(gap > 1, "train")
                .when((gap == 1) & _before(.45), "train").when((gap == 1) & _before(.75), "validation")
                .when((gap == 1) & _before(.90), "probability_calibration")
                .when(gap == 1, "interval_calibration"))
    else:
        half = F.col("day_index") < F.floor(F.col("season_days") / 2)
        rule = F.when(gap == 0, "test").when(gap == 2, "validation").when(gap > 2, "train")
        if strategy == "refit_plus":
            rule = rule.when((gap == 1) & _before(.50), "refit_extra") \
                .when((gap == 1) & _before(.75), "probability_calibration").when(gap == 1, "interval_calibration")
        elif strategy in ("legacy", "refit"):
            rule = rule.when((gap == 1) & half, "probability_calibration").when(gap == 1, "interval_calibration")
        else:
            raise ValueError(f"unknown strategy {strategy}")
    return rule


def walk_forward_labels(df: DataFrame, folds: int = 3, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """(strategy, test_season, date, partition) for the last ``folds`` seasons.

    Folds with an empty partition, or a calibrating season of fewer than eight dates, are dropped.
    """
    days = date_table(df)
    newest = F.max("season").over(W.partitionBy(F.lit(0)))
    arms = F.array(*[F.lit(s) for s in strategies])
    wide = days.withColumn("_newest", newest).select(
        "*", F.explode(F.sequence(F.col("_newest") - folds + 1, F.col("_newest"))).alias("test_season"))
    wide = wide.select("*", F.explode(arms).alias("strategy"))
    label = F
    for s in strategies:
        label = label.when(F.col("strategy") == s, strategy_label(s, F.col("test_season")))
    labelled = wide.withColumn("partition", label).filter(F.col("partition").isNotNull())
    fold = W.partitionBy("strategy", "test_season")
    parts = F.size(F.collect_set("partition").over(fold))
    days_before = F.max(F.when(F.col("season") == F.col("test_season") - 1, F.col("season_days"))).over(fold)
    needed = F.when(F.col("strategy") == "refit_plus", 6).otherwise(5)
    enough = (F.col("strategy") == "legacy") | (F.col("_calibration_days") >= MIN_DATES)
    checked = labelled.select("*", parts.alias("_parts"), days_before.alias("_calibration_days"))
    return checked.filter((F.col("_parts") == needed) & enough) \
        .select("strategy", "test_season", "date", "partition")


def partition_summary(df: DataFrame, group: Sequence[str] = ("partition",)) -> DataFrame:
    """Start, end, number of matches and overs; matches are combined before the count."""
    per_match = df.groupBy(*group, "match_id").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n"))
    return per_match.groupBy(*group).agg(
        F.min("lo").alias("start"), F.max("hi").alias("end"), F.count(F.lit(1)).alias("matches"),
        F.sum("n").alias("overs"))


def partition_overlap(df: DataFrame) -> DataFrame:
    """Matches that occur in more than one partition (must be none)."""
    return df.groupBy("match_id").agg(
        F.min("partition").alias("first_partition"), F.max("partition").alias("last_partition")) \
        .filter(F.col("first_partition") != F.col("last_partition"))


def require_partitions(df: DataFrame, expected: Sequence[str] = PARTITIONS) -> DataFrame:
    """``df`` as it is, after failing on an empty partition, partitions that share dates, or a match in two of them."""
    found = {r["partition"]: r for r in partition_summary(df).collect()}          # one row per partition
    missing = [p for p in expected if p not in found]
    if missing:
        raise ValueError(f"empty partitions: {', '.join(missing)}")
    ordered = sorted(found.values(), key=lambda r: (r["start"], r["end"]))
    shared = [f"{a['partition']} and {b['partition']}" for a, b in zip(ordered, ordered[1:]) if b["start"] <= a["end"]]
    if shared:
        raise ValueError(f"partitions share dates: {'; '.join(shared)}")
    if partition_overlap(df).limit(1).count():
        raise ValueError("a match is in two partitions")
    return df


def recorded_windows(df: DataFrame) -> DataFrame:
    """(partition, start, end): the date windows of a split, to be used on another data set."""
    return partition_summary(df).select("partition", "start", "end")


def by_windows(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Label the rows of another data set by recorded windows; rows of dates outside all windows are left out."""
    label = F.lit(None).cast("string")
    for r in windows.collect():                                                     # one row per partition
        label = F.when(F.col("date").between(F.lit(r["start"]), F.lit(r["end"])), r["partition"]).otherwise(label)
    return df.withColumn("partition", label).filter(F.col("partition").isNotNull())
