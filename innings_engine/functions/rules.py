"""Named validation rules: a rule is a condition that must NOT hold."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def first_failure(rules: Mapping[str, Column]) -> Column:
    """Name of the first broken rule in the given order; null when all hold."""
    out = F
    for name, broken in rules.items():
        out = out.when(F.coalesce(broken, F.lit(False)), name)
    return out.otherwise(F.lit(None).cast("string"))


def all_failures(rules: Mapping[str, Column]) -> Column:
    """Array of every broken rule."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))


def divide(df: DataFrame, rules: Mapping[str, Column], reason: str = "reject_reason"):
    """(valid rows, rejected rows with ``reason``)."""
    judged = df.withColumn(reason, first_failure(rules))
    return judged.filter(F.col(reason).isNull()).drop(reason), judged.filter(F.col(reason).isNotNull())


def strict(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Fail the job on the first bad row instead of quarantining it."""
    reason = first_failure(rules)
    return df.withColumn("_checked", F.when(reason.isNotNull(), F.raise_error(reason))) \
        .filter(F.col("_checked").isNull()).drop("_checked")
