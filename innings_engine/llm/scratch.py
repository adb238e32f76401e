"""Tables that an operator writes between its passes, below ``spark.checkpoint.dir``.

They are parquet in the shared folder: a lost executor costs only the tasks it ran, and lineage ends there.
"""
from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_WRITTEN: list[str] = []
#: Folder that holds the package.
_HOME = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it; a cluster without it there ships it as usual."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_HOME, *filter(None, paths)])


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under a fresh name and read it back."""
    spark = df.sparkSession
    importable(spark)
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete every table kept so far; only for callers that have stored the results built on them."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; also makes the package importable for the workers."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
