"""Model inputs: categories, weights, standardisation, feature families and selection."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

HALF_LIVES = [1460, 730, 365]
CLIP_SIGMAS = 8
SIGMA_FLOOR = 1e-6


def family(name: Column, families: Mapping[str, str]) -> Column:
    """Family of a feature, "base" for a name that no group declares."""
    pairs = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), F.lit("base"))


def unpivot(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep..., feature, value) in one pass."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def fill_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing categories become "unknown"; columns a table does not have are ignored."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in present})


def ordinal_codes(train: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct training values from 0. One row per category."""
    values = train.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return values.select("value", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("value")) - 1).alias("code"))


def category_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): ``ordinal_codes`` of several columns from one pass."""
    cells = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in columns])
    values = train.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("value").isNotNull()).distinct()
    return values.select("column", "value", (F.row_number().over(W.partitionBy("column").orderBy("value")) - 1).alias("code"))


def ordinal_encode(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """Code of the category, -1 when the training rows never had it."""
    side = codes.select(F.col("value").alias(column), F.col("code").alias(out))
    return df.join(side, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def recency_weight(date: Column, newest: Column, half_life_days: float) -> Column:
    """1 at the newest date, one half a half-life earlier."""
    return F.exp(-F.log(F.lit(2.0)) * F.datediff(newest, date) / F.lit(float(half_life_days)))


def train_moments(train: DataFrame, features: Sequence[str]) -> Column:
    """Means and population deviations of the training rows as one struct (scalar subquery)."""
    values = [x for f in features for x in (F.avg(F.col(f).cast("double")).alias(f"m_{f}"),
                                            F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}"))]
    row = train.agg(*values)
    return row.select(F.struct(*row.columns).alias("moments")).scalar()


def standardize(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """z-scores with training statistics, clipped to eight deviations; tiny deviations count as 1."""
    held = df.withColumn("_m", train_moments(train, features))
    z = {}
    for f in features:
        sigma = F.when(F.col("_m")[f"s_{f}"] < SIGMA_FLOOR, 1.0).otherwise(F.col("_m")[f"s_{f}"])
        raw = (F.col(f).cast("double") - F.col("_m")[f"m_{f}"]) / sigma
        z[f] = F.least(F.greatest(raw, F.lit(-float(CLIP_SIGMAS))), F.lit(float(CLIP_SIGMAS)))
    return held.withColumns(z).drop("_m")


def top_contributions(long: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """The k largest |value| per row of a (key, feature, value) table; a row has few features."""
    w = W.partitionBy(*key).orderBy(F.abs(F.col("value")).desc(), "feature")
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def half_up(digits: int = 6) -> Callable[[np.ndarray], np.ndarray]:
    """Rounds finite values as Spark's ``round`` does, which goes by a number's shortest text; only those next to a tie need it.

    The function travels to the tasks by value, so workers need not have this package.
    """
    def rounded(x: np.ndarray) -> np.ndarray:
        scaled = np.abs(x) * 10 ** digits
        out = np.copysign(np.floor(scaled + .5) / 10 ** digits, x) + 0.0
        for at in zip(*np.nonzero(np.abs(scaled % 1 - .5) < 1e-6)):
            out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
        return out
    return rounded


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows chosen by a hash of their key and the seed, returned in key order; repeatable."""
    mark = F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in key], F.lit(str(seed))).cast("binary"))
    return df.orderBy(mark, *key).limit(n).orderBy(*key)


def explained_share(x: Column, y: Column) -> Column:
    """Aggregate: squared correlation, 0 for a constant column."""
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) * F.covar_pop(x, y) / spread).otherwise(0.0)


def drop_by_importance(importance: DataFrame, threshold: float = 0.0):
    """(kept, dropped) features of a (feature, mae_increase) table."""
    dropped = importance.filter(F.col("mae_increase") <= threshold)
    return importance.join(dropped.select("feature"), "feature", "left_anti"), dropped


def distinct_score_join(df: DataFrame, state: Sequence[str], score: Mapping[str, Column]) -> DataFrame:
    """Score each distinct state once and join the result back to every row, rows with null state columns included."""
    key = F.struct(*state)  # nulls inside a struct are equal to each other
    scored = df.select(*state).distinct().select(key.alias("_state"), *[c.alias(n) for n, c in score.items()])
    return df.withColumn("_state", key).join(scored, "_state").drop("_state")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content mark: row count and the sum of 60-bit heads of each row's sha256.

    Every value carries its length and a null is a mark of its own, so no two different rows read alike.
    """
    value = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    text = F.concat_ws("|", *[value(F.col(c)) for c in sorted(df.columns)])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(head).alias("digest"))


def schema_hash(df: DataFrame) -> str:
    import hashlib
    return hashlib.sha256("|".join(df.columns).encode()).hexdigest()
