"""Prediction and outcome logs: freshness, idempotence, reconciliation and monitoring."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .metrics import error_columns

MAX_AGE_SECONDS, MAX_AHEAD_SECONDS = 30, 5


def freshness_reason(age_seconds: Column, match: Column, expected: Column) -> Column:
    """Null for a state that may be used."""
    return (F.when(age_seconds > MAX_AGE_SECONDS, "stale")
            .when(age_seconds < -MAX_AHEAD_SECONDS, "future")
            .when(match != expected, "different_match"))


def prediction_id(version: Column, state: Column) -> Column:
    return F.sha2(F.concat(version, state), 256)


def first_per_id(log: DataFrame, key: str, at: str, payload: list[str]) -> DataFrame:
    """The stored record of each id: its first arrival, combined on the map side."""
    first = F.min(F.struct(at, *payload)).alias("f")
    return log.groupBy(key).agg(first, F.count(F.lit(1)).alias("arrivals")).select(key, "f.*", "arrivals")


def reconcile_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str, value: str) -> DataFrame:
    """Per outcome id: recorded, conflict (two different values) or unknown (no prediction)."""
    seen = outcomes.groupBy(key).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("reports"))
    known = predictions.select(key).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col("low") != F.col("high"), "conflict").otherwise("recorded")
    return seen.join(known, key, "left").select(key, "reports", status.alias("status"),
                                                F.when(status == "recorded", F.col("low")).alias(value))


def newest_records(records: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` records in ``order``: a view of its own for a caller who asks for one."""
    return records.orderBy(*order).limit(n)


def monitoring(records: DataFrame) -> DataFrame:
    """Metrics per model version over all records that have an outcome.

    ``records``: version, y (null while awaited), p, lower, upper, wicket, wicket_p. A version
    with a single outcome reports its error only.
    """
    done = records.filter(F.col("y").isNotNull())
    inside = ((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double")
    base = error_columns()
    gap = F.col("wicket_p") - F.col("wicket")
    out = done.groupBy("version").agg(
        *[c.alias(n) for n, c in base.items()], F.avg(inside).alias("interval_coverage"), F.avg(gap * gap).alias("wicket_brier"))
    several = [n for n in base if n not in ("n", "mae")]
    return out.withColumns({n: F.when(F.col("n") > 1, F.col(n)) for n in several})
