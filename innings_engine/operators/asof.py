"""As-of reads: what was known about a key strictly before a date.

Rows of the probe's own date are never visible, whichever match they belong to. Facts are
summed per (key, date) first, so windows run over at most one row per key and date, however
many deliveries a key has; a hot key is combined on the map side before any shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def day_number(date: str = "date"):
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def asof_totals(facts: DataFrame, probes: DataFrame | None, keys: Sequence[str],
                measures: Sequence[str], date: str = "date") -> DataFrame:
    """Totals of ``measures`` over dates before each (key, date) found in facts or probes.

    Probes enter as zero-valued facts, which turns the range condition into a running sum.
    """
    columns = [*keys, date]
    daily = facts.select(*columns, *[F.col(m).cast("bigint").alias(m) for m in measures])
    if probes is not None:
        zero = probes.select(*columns, *[F.lit(0).cast("bigint").alias(m) for m in measures])
        daily = daily.unionByName(zero)
    daily = daily.groupBy(*columns).agg(*[F.sum(m).alias(m) for m in measures])
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(date)
    w = w.rowsBetween(W.unboundedPreceding, -1)
    return daily.select(*columns, *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(m) for m in measures])


def asof_latest(states: DataFrame, probes: DataFrame, keys: Sequence[str], payload: str,
                date: str = "date") -> DataFrame:
    """Latest non-null ``payload`` of a key on a date before each distinct probe (key, date)."""
    columns = [*keys, date]
    kind = states.schema[payload].dataType
    marked = states.select(*columns, payload, F.lit(False).alias("_probe"))
    asked = probes.select(*columns).distinct().select(
        *columns, F.lit(None).cast(kind).alias(payload), F.lit(True).alias("_probe"))
    w = W.partitionBy(*keys).orderBy(day_number(date)).rangeBetween(W.unboundedPreceding, -1)
    known = marked.unionByName(asked).select(
        *columns, "_probe", F.last(payload, ignorenulls=True).over(w).alias(payload))
    return known.filter("_probe").drop("_probe")


def history_cutoff(log: DataFrame) -> DataFrame:
    """Last date whose matches may inform each date: the previous date in the log."""
    dates = log.select("date").distinct()           # one row per day
    return dates.select("date", F.lag("date").over(W.partitionBy(F.lit(0)).orderBy("date"))
                        .alias("history_through"))
