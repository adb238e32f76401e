"""The whole forecast of an over in one row: total, bounds, probabilities, components, label and reason."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import metrics as m, reliability as rl
from ..operators.blend import COMPONENTS, reconcile


def wide_events(events: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """One row per key with a probability per event."""
    return events.groupBy("row_key").agg(*[F.max(F.when(F.col("task") == t, F.col("p"))).alias(f"{t}_probability") for t in tasks])


def forecast_rows(labelled: DataFrame, total: Column, radii: Mapping[str, Column], events: DataFrame, buckets: DataFrame, classes: int) -> DataFrame:
    """``labelled`` has one row per ``row_key`` with the columns of the labels and the component means ``c_*``.

    ``radii`` are interval radii by suffix, ``events`` a wide table, ``buckets`` (row_key, probs). Both join on the unique row
    key; everything else is computed in the row.
    """
    bounds = {}
    for suffix, radius in radii.items():
        low, high = m.interval_columns(total, radius)
        bounds |= {f"lower_{suffix}": low.cast("double"), f"upper_{suffix}": high.cast("double")}
    parts = reconcile(total, {n: F.col(f"c_{n}") for n in COMPONENTS}, F.col("c_bowler_conceded"))
    rows = labelled.select(
        "row_key", total.alias("expected_runs"), *[c.alias(n) for n, c in bounds.items()], *[c.alias(f"expected_{n}") for n, c in parts.items()],
        "label", rl.reason().alias("reason"))
    probabilities = [F.col("probs")[i].alias(f"bucket_{i}_probability") for i in range(classes)]
    return rows.join(events, "row_key").join(buckets.select("row_key", *probabilities), "row_key")
