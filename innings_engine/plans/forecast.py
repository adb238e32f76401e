"""Baseline forecasts over the sample table, in wide and long form."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.split import require_partitions, with_partition
from ..sources.delivery_log import OVER_KEY, delivery_log
from ..session import all_written
from .over_table import GROUPS, over_samples
from .staging import staged_once, staged_path

MODELS = ["league_mean", "over_number_mean", "recent_run_rate", "batter_bowler_history"]
CHAMPION, CANDIDATE = "over_number_mean", "batter_bowler_history"
TARGET = "target_next_over_runs"


def staged_log_path(spark, sf_dir: str) -> str:
    return staged_path(spark, ("log", sf_dir), lambda: delivery_log(spark, sf_dir))


def staged_log(spark, sf_dir: str) -> DataFrame:
    """The delivery log as a written table, once per session; jobs that branch read this."""
    return spark.read.parquet(staged_log_path(spark, sf_dir))


#: Feature families of the three sample tables: the opening state and targets, what forecasts and their reports read, everything.
STATE, REPORT, FULL = (), ("career", "era", "innings", "matchup", "venue"), tuple(GROUPS)
#: The opening state and the careers that the history forecast needs.
HISTORY = ("career",)
#: What the models read: single past balls are no features.
MODEL = tuple(g for g in GROUPS if g != "lags")
#: What the ball sample reads: everything but the ball windows.
BALL = ("innings", "era", "players", "form", "positions", "matchup", "context")


def samples(spark, sf_dir: str, groups: Sequence[str] = FULL) -> DataFrame:
    """Partition-labelled over samples with the feature families ``groups``; the unlabelled table is written once per session.

    Every table has all usable overs and every target; a query asks for the families it reads.
    """
    def build():
        return over_samples(staged_log(spark, sf_dir), groups, all_written)
    return with_partition(staged_once(spark, ("samples", sf_dir, *groups), build))


def over_means(train: DataFrame, value: str = TARGET) -> DataFrame:
    """Mean per over number (at most twenty rows)."""
    return train.groupBy("over_number").agg(F.avg(value).alias("over_mean"))


def baselines(df: DataFrame, train: DataFrame) -> DataFrame:
    """The four baselines as columns; means come from ``train`` only."""
    overall = train.agg(F.avg(TARGET).alias("m")).scalar()
    joined = df.join(F.broadcast(over_means(train)), "over_number", "left")
    return joined.select(
        *df.columns,
        overall.alias("league_mean"),
        F.coalesce(F.col("over_mean"), overall).alias("over_number_mean"),
        F.when(F.col("over_number") > 1, F.col("current_run_rate")).otherwise(overall).alias("recent_run_rate"),
        (3 * F.col("batter_career_strike_rate") / 100 + 0.5 * F.col("bowler_career_economy"))
        .alias("batter_bowler_history"))


def predictions(spark, sf_dir: str, groups: Sequence[str] = REPORT) -> DataFrame:
    """Samples of the families ``groups`` with ``y`` and the four baseline columns fitted on the training partition.

    Written once per session: every metric reads this table.
    """
    def build():
        df = require_partitions(samples(spark, sf_dir, groups))
        return baselines(df, df.filter(F.col("partition") == "train")).withColumn("y", F.col(TARGET))
    return staged_once(spark, ("predictions", sf_dir, *groups), build)


def long_form(wide: DataFrame, keep, models=MODELS) -> DataFrame:
    """(keep..., model, p): one row per model."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models])
    return wide.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.model", "_m.p")


def row_key():
    return F.concat_ws("/", *[F.col(c).cast("string") for c in OVER_KEY])
