"""Exact ordered prefix sums that never put one whole group into one task.

A plain ``sum().over(partitionBy(group).orderBy(key))`` sends a group to a single task.
Here each group is cut into order-preserving slices: slice totals give the offset of a
slice, a window inside the slice gives the rest. Both shuffles are keyed on
(group, slice), so a group holding a third of the data is spread over many tasks.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written

SLICE = "_slice"
KEY = "_slice_key"


def sliced_prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str],
                       sums: Mapping[str, str], totals_too: bool = False) -> DataFrame:
    """Add ``out = sum(measure)`` over the earlier rows of the group, for measure->out in ``sums``.

    ``df`` carries the column ``_slice``: a non-decreasing function of the order columns.
    With ``totals_too`` the group's whole sum comes along as ``<measure>_total``.
    """
    # One struct key serves the totals, the window and the join, so rows are shuffled once. A
    # struct is never null itself and equal null fields match, so null groups keep their rows.
    keyed = df.withColumn(KEY, F.struct(*group, SLICE))
    totals = keyed.groupBy(KEY).agg(*[F.sum(m).alias(f"_t_{o}") for m, o in sums.items()])
    whole = W.partitionBy(*[F.col(KEY)[g] for g in group]) if group else W.partitionBy(F.lit(0))
    before = whole.orderBy(F.col(KEY)[SLICE]).rowsBetween(W.unboundedPreceding, -1)
    extra = [F.sum(f"_t_{o}").over(whole).alias(f"{m}_total") for m, o in sums.items()] if totals_too else []
    offsets = totals.select(KEY, *[
        F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums.values()], *extra)
    inside = W.partitionBy(KEY).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = keyed.select("*", *[
        F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_l_{o}") for m, o in sums.items()])
    joined = local.join(offsets, KEY)
    return joined.select(
        *[c for c in df.columns if c != SLICE],
        *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums.values()],
        *([f"{m}_total" for m in sums] if totals_too else []))


def value_slices(df: DataFrame, value: str, slices: int | None = None) -> DataFrame:
    """Add ``_slice`` from approximate quantiles of ``value`` (a one-row scalar subquery)."""
    if slices is None:
        slices = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / slices for i in range(1, slices)]
    edges = df.select(F.percentile_approx(value, cuts, 1000).alias("e")).scalar()
    # The subquery becomes a column first: it may not stand inside a higher-order function.
    edged = df.withColumn("_edges", F.coalesce(edges, F.array().cast("array<double>")))
    return edged.withColumn(SLICE, F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")


def distribution(df: DataFrame, group: Sequence[str], value: str,
                 sums: Mapping[str, Column] | None = None, slices: int | None = None,
                 descending: bool = False) -> DataFrame:
    """One row per (group, distinct value): ``n``, ``n_before`` (rows ahead of it) and ``n_total``.

    Extra ``sums`` are aggregated per value and get ``<name>_before`` and ``<name>_total`` too.
    """
    sums = dict(sums or {})
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    key = F.col(value).cast("double")
    # Written once: slice edges, slice totals and the window inside slices all read it.
    counts = written(counts.withColumn("_key", -key if descending else key), "counts")
    sliced = value_slices(counts, "_key", slices)
    return sliced_prefix_sums(sliced, group, ["_key"], {m: f"{m}_before" for m in ["n", *sums]},
                              totals_too=True).drop("_key")


def kth_smallest(df: DataFrame, group: Sequence[str], value: str, rank: Column,
                 slices: int | None = None) -> DataFrame:
    """Value at the 1-based ``rank``, an expression over the group size ``n_total``."""
    spread = distribution(df, group, value, slices=slices).withColumn("rank", rank.cast("bigint"))
    hit = (F.col("n_before") < F.col("rank")) & (F.col("rank") <= F.col("n_before") + F.col("n"))
    return spread.filter(hit).select(*group, F.col("n_total").alias("n"), "rank",
                                     F.col(value).alias("value"))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                    quantiles: Mapping[str, float], slices: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per quantile."""
    spread = distribution(df, group, value, slices=slices)
    after, v = F.col("n_before") + F.col("n"), F.col(value).cast("double")
    picks = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("n_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("n_before") <= rank) & (rank < after)
            picks.append(F.max(F.when(holds, v)).alias(f"_{side}_{name}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_w_{name}"))
    picked = spread.groupBy(*group).agg(*picks)
    return picked.select(*group, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
        for n in quantiles])
