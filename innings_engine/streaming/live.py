"""Structured Streaming forms of the online parts, run to completion with ``availableNow``.

Logs and history are tables that each micro-batch extends: what was stored before decides what is new, so nothing is lost to
a watermark, however late it comes. A batch that runs again overwrites only its own folders, and reads only those of
earlier batches.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.logs import first_per_id
from ..session import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a folder with the schema of ``like``; a rate limit is the caller's choice."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def deliveries(table: DataFrame, part: Column, parts: int, name: str) -> Iterator[DataFrame]:
    """The stream of a table that arrives in ``parts`` deliveries; each step adds one and yields the stream to be run."""
    spark, folder = table.sparkSession, _folder(table.sparkSession, f"{name}-in")
    for k in range(parts):
        table.where(part == k).write.mode("append").parquet(folder)
        yield read_stream(spark, folder, table)


def run_update(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Update-mode aggregation: each micro-batch overwrites its own folder, the newest row per key wins."""
    base = _folder(df.sparkSession, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/epoch={epoch}")

    query = (df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    values = [c for c in df.columns if c not in keys]
    written = df.sparkSession.read.parquet(f"{base}/data")
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return latest.select(*keys, "v.*")


def _run(streams: Iterator[DataFrame], checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run each delivery to its end; one checkpoint carries on from run to run."""
    for df in streams:
        query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def append_new(streams: Iterator[DataFrame], shape: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """Idempotent log: of each id the first arrival is stored, by batch and then by ``at`` and the other columns.

    ``shape`` has the columns of the streams. A batch drops the ids that earlier batches stored (an anti join on the key),
    so a repeat is recognised after any time.
    """
    spark, base = shape.sparkSession, _folder(shape.sparkSession, name)
    payload = [c for c in shape.columns if c not in (key, at)]
    stored = shape.select(key, at, *payload)
    schema = f"{stored.schema.toDDL()}, epoch int"

    def write(batch: DataFrame, epoch: int) -> None:
        first = first_per_id(batch, key, at, payload).drop("arrivals")
        if epoch:
            before = batch.sparkSession.read.schema(schema).parquet(f"{base}/data").where(F.col("epoch") < epoch)
            first = first.join(before.select(key), key, "left_anti")
        first.select(stored.columns).write.mode("overwrite").parquet(f"{base}/data/epoch={epoch}")

    _run(streams, f"{base}/checkpoint", write)
    return spark.read.schema(schema).parquet(f"{base}/data")


def gated(streams: Iterator[DataFrame], shape: DataFrame, reason: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason``): every arrival is in one of two sinks; ``reason`` is null for a good row."""
    spark, base = shape.sparkSession, _folder(shape.sparkSession, name)

    def write(batch: DataFrame, epoch: int) -> None:
        judged = batch.withColumn("reason", reason)
        judged.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{base}/accepted/epoch={epoch}")
        judged.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{base}/rejected/epoch={epoch}")

    _run(streams, f"{base}/checkpoint", write)
    schema = shape.schema.toDDL()
    return (spark.read.schema(f"{schema}, epoch int").parquet(f"{base}/accepted"),
            spark.read.schema(f"{schema}, reason string, epoch int").parquet(f"{base}/rejected"))


def with_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Every stored prediction with the stored outcome of its id; ``awaiting`` until there is one. Both logs have unique ids."""
    known = outcomes.withColumn("_seen", F.lit(True))
    joined = predictions.join(known, key, "left")
    return joined.withColumn("status", F.when(F.col("_seen"), "recorded").otherwise("awaiting")).drop("_seen")


def running_innings(balls: DataFrame) -> DataFrame:
    """Score, wickets and balls of each innings as deliveries arrive (update mode)."""
    return balls.groupBy("match_id", "innings").agg(
        F.sum("runs_total").alias("score"), F.sum("wicket").alias("wickets"), F.sum("legal").alias("legal_balls"),
        F.count(F.lit(1)).alias("deliveries"))


def closed_day_facts(streams: Iterator[DataFrame], shape: DataFrame, at: str, keys: Sequence[str], value: str,
                     lateness_days: int, name: str) -> tuple[DataFrame, DataFrame]:
    """History commit: (facts of closed days, late rows).

    A day is closed once an arrival is later than its end by the allowed lateness. Nothing of a day is visible while it is
    open; a row that comes after its day was closed by an earlier batch goes to the late rows, whole, and never changes
    published facts.
    """
    spark, base = shape.sparkSession, _folder(shape.sparkSession, name)
    day = F.col(at).cast("date")
    closed = lambda mark: F.date_add(day, 1 + lateness_days) <= mark
    marks = "mark timestamp, epoch int"

    def mark_before(session: SparkSession, epoch: int):
        table = session.read.schema(marks).parquet(f"{base}/marks").where(F.col("epoch") < epoch)
        return table.agg(F.max("mark").alias("m")).first()["m"]

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        batch.agg(F.max(F.col(at).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(f"{base}/marks/epoch={epoch}")
        before = mark_before(session, epoch) if epoch else None
        late = closed(F.lit(before)) if before is not None else F.lit(False)
        batch.where(late).write.mode("overwrite").parquet(f"{base}/late/epoch={epoch}")
        part = batch.where(~late | F.col(at).isNull()).groupBy(day.alias("date"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("double").alias("total"))
        part.write.mode("overwrite").parquet(f"{base}/facts/epoch={epoch}")

    _run(streams, f"{base}/checkpoint", write)
    kinds = {f.name: f.dataType.simpleString() for f in shape.schema.fields}
    facts = spark.read.schema(", ".join(["date date", *[f"{k} {kinds[k]}" for k in keys], "n long, total double, epoch int"])).parquet(f"{base}/facts")
    mark = spark.read.schema(marks).parquet(f"{base}/marks").agg(F.max("mark")).first()[0]
    done = facts.where(F.date_add("date", 1 + lateness_days) <= F.lit(mark)).groupBy("date", *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return done, spark.read.schema(f"{shape.schema.toDDL()}, epoch int").parquet(f"{base}/late")
