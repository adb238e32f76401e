"""Event and run-bucket probabilities from as-of frequencies, as a long table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cricket import RUN_BUCKET_NAMES, SHRINK_BALLS
from ..operators.asof import asof_totals
from ..operators.metrics import same_group
from ..session import written
from .forecast import STATE, row_key, samples
from .staging import staged_once

EVENTS = ["wicket", "boundary", "six", "ten_plus"]
CLASSES = len(RUN_BUCKET_NAMES)


def event_rates(df: DataFrame) -> DataFrame:
    """(task, y, p) per over: the bowler's share of such overs before the date, shrunk to the league's.

    The as-of table is written first, so that its size decides the join before any over is shuffled for it.
    """
    facts = df.select("bowler", "date", F.lit(1).alias("n"), *[F.col(f"target_{e}").alias(e) for e in EVENTS])
    names = ["n", *EVENTS]
    own = written(asof_totals(facts, None, ["bowler"], names), "bowler_events")
    league = asof_totals(facts, None, [], names).withColumnsRenamed({m: f"all_{m}" for m in names})
    joined = same_group(df, own, ["bowler", "date"]).join(F.broadcast(league), "date")     # league: one row per day
    rate = lambda e: (F.col(e) + SHRINK_BALLS * F.col(f"all_{e}") / F.greatest(F.col("all_n"), F.lit(1))) \
        / (F.col("n") + SHRINK_BALLS)
    tasks = F.array(*[F.struct(F.lit(e).alias("task"), F.col(f"target_{e}").alias("y"), rate(e).alias("p")) for e in EVENTS])
    return joined.select(row_key().alias("row_key"), "match_id", "partition", "phase", F.explode(tasks).alias("t")) \
        .select("row_key", "match_id", "partition", "phase", "t.*")


def bucket_rates(df: DataFrame) -> DataFrame:
    """(y, probs) per over: run-bucket frequencies of the phase before the date, plus one."""
    names = [f"b{i}" for i in range(CLASSES)]
    bucket = F.col("target_run_bucket")
    facts = df.select("phase", "date", *[F.when(bucket == i, 1).otherwise(0).alias(f"b{i}") for i in range(CLASSES)])
    seen = written(asof_totals(facts, None, ["phase"], names), "phase_buckets")
    total = sum((F.col(n) for n in names), F.lit(0))
    probs = F.array(*[(F.col(n) + 1) / (total + CLASSES) for n in names])
    return same_group(df, seen, ["phase", "date"]).select(
        row_key().alias("row_key"), "match_id", "partition", "phase", bucket.alias("y"), probs.alias("probs"))


def event_table(spark, sf_dir: str) -> DataFrame:
    """Binary (row_key, match_id, partition, phase, task, y, p), written once per session."""
    return staged_once(spark, ("events", sf_dir), lambda: event_rates(samples(spark, sf_dir, STATE)))


def probability_table(spark, sf_dir: str, partition: str = "test") -> DataFrame:
    """(row_key, match_id, phase, task, y, probs) of one partition; rates see all earlier overs."""
    def build():
        binary = event_table(spark, sf_dir).select(
            "row_key", "match_id", "partition", "phase", "task", "y", F.array(1 - F.col("p"), F.col("p")).alias("probs"))
        multi = bucket_rates(samples(spark, sf_dir, STATE)).select(
            "row_key", "match_id", "partition", "phase", F.lit("run_bucket").alias("task"), "y", "probs")
        return binary.unionByName(multi)
    table = staged_once(spark, ("probabilities", sf_dir), build)
    return table.filter(F.col("partition") == partition).drop("partition")
