"""File sources and sinks: logs, alias dimensions, reports and the feature store."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F



def write_log(log: DataFrame, path: str) -> None:
    """Delivery log by season, sorted within each file by the total order."""
    order = ["date", "match_id", "innings", "over_number", "ball_number"]
    log.repartition("season", "match_id").sortWithinPartitions("season", *order) \
        .write.mode("overwrite").partitionBy("season").parquet(path)


def read_log(spark: SparkSession, path: str, seasons=None) -> DataFrame:
    """Delivery log; ``seasons`` prunes folders."""
    log = spark.read.parquet(path)
    return log.filter(F.col("season").isin(list(seasons))) if seasons is not None else log


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Curated renames: alias, canonical, reason."""
    return spark.read.schema("alias string, canonical string, reason string").option("header", True).csv(path)


def apply_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace aliases by canonical names; AQE broadcasts the dimension when it is small."""
    side = aliases.select(F.col("alias").alias(column), F.col("canonical").alias("_canonical"))
    return df.join(side, column, "left").withColumn(column, F.coalesce("_canonical", column)).drop("_canonical")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Long metric table (metric, segment, value) as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def write_store(tables: Mapping[str, DataFrame], path: str | None = None, jdbc_url: str | None = None,
                properties: Mapping[str, str] | None = None) -> None:
    """Replace every store table wholesale: folders under ``path`` and, if given, database tables."""
    for name, table in tables.items():
        if path:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        if jdbc_url:
            table.write.mode("overwrite").jdbc(jdbc_url, name, properties=dict(properties or {}))
