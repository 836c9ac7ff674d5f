"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a temporary folder; on a cluster it is an error, as executors don't see each other's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _unset_dir()


@cache
def _unset_dir() -> str:
    return tempfile.mkdtemp(prefix="trailmill-shared-", dir="/tmp")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends there.

    ``files``: rows are dealt to so many tasks first, which write a file each. Where the folder is local, Hadoop starts a child process for each file's mode,
    and a child that is just starting counts as its executor's memory once more; so what many short tasks find is better written by few.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if files is None else df.repartition(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
