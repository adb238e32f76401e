"""Written stages: tables that several jobs read, kept in the shared folder.

A stage is a parquet table, so it survives lost executors and is read with column pruning.
Within one session a stage of the same inputs is written once.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder, shuffles_freed

_WRITTEN: dict[tuple, str] = {}


def _readable(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _version(spark: SparkSession, folder: str) -> int:
    """Newest change of the tables in an input folder, so that a rewritten input is a new stage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return max([0, *(s.getModificationTime() for s in system.listStatus(path))]) if system.exists(path) else 0


def staged_path(spark: SparkSession, key: tuple, build, **options: str) -> str:
    """Folder of the stage ``key`` (name, input folder) in this application, written by ``build()`` when absent; ``options`` are the writer's."""
    full = (spark.sparkContext.applicationId, *key, _version(spark, key[1]))
    path = _WRITTEN.get(full)
    if path is None or not _readable(spark, path):
        path = f"{shared_folder(spark)}/stage-{key[0]}-{uuid.uuid4().hex}"
        df = build()
        with shuffles_freed(spark):
            df.write.options(**options).parquet(path)
        _WRITTEN[full] = path
    return path


def staged_once(spark: SparkSession, key: tuple, build, **options: str) -> DataFrame:
    return spark.read.parquet(staged_path(spark, key, build, **options))
