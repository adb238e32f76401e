"""Session defaults used by the tests, the benchmark and standalone jobs."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "innings-engine", master: str | None = None) -> SparkSession:
    """Local session with the settings the jobs rely on; a cluster supplies its own."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Tables already partitioned by match join on (match, innings, over) without a new shuffle.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.log.level", "ERROR")
    )
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written stages: the cluster's ``spark.checkpoint.dir``.

    Only when the session names none (tests, single machine) is a scratch folder
    created and recorded in the session, so that every job of the run agrees on it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = spark.conf.get("innings.scratch.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("innings.scratch.dir", folder)
    return folder.rstrip("/")


#: Shuffle files go as soon as the statement that made them has ended, not when the driver's memory is next collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: they are read from storage, and no plan of theirs runs again."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str, partition_by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back from storage, cutting its lineage; ``options`` are the writer's."""
    path = f"{shared_folder(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffles_freed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def all_written(tables: dict[str, DataFrame], at_once: int = 4) -> dict[str, DataFrame]:
    """``written`` for several independent tables: small jobs that would wait for each other's planning run side by side."""
    if not tables:
        return {}
    # Around all of them: one table's end must not change the setting of the others.
    with shuffles_freed(next(iter(tables.values())).sparkSession), ThreadPoolExecutor(at_once) as pool:
        found = {name: pool.submit(inheritable_thread_target(df.sparkSession)(written), df, name) for name, df in tables.items()}
        return {name: f.result() for name, f in found.items()}
