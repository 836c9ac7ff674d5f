"""Whole files by path: scans, what lies beside a file, several inputs of which some fail."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def scan(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, directory, file, text: a row for each file under ``folder`` whose name fits ``pattern``, its text whole. An empty file has the empty text. Without a fitting file: no rows."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), directory(path).alias("directory"), file_name(path).alias("file"), F.col("value").alias("text"))


def pack(files: DataFrame, folder: str) -> None:
    """Writes files (path within the folder, text; null: no such file) as a packed folder: a table of whole files with their paths.

    For very many small files: each loose one costs a listing, an opening and a mode of its own, on disk and in the driver.
    """
    files.select("path", "text").where("text IS NOT NULL").write.parquet(folder)


def scan_packed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """As ``scan``, of a packed folder. In ``pattern``, ``*`` stands for any characters and ``?`` for one."""
    fits = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    rows = spark.read.schema("path string, text string").parquet(folder)
    path = F.concat(F.lit(f"{folder.rstrip('/')}/"), F.col("path"))
    return rows.select(path.alias("path"), directory(path).alias("directory"), file_name(path).alias("file"), "text").where(F.col("file").rlike(rf"(?s)\A{fits}\z"))


def with_sibling(files: DataFrame, siblings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with ``sibling``, the text of the file beside them, and path, reason of those that are left out: no sibling, or one that is no JSON object.

    The directory is the key: nothing is opened by name, so the join is one shuffle whatever the number of folders. Of several siblings in a directory the first by path counts.
    """
    first = siblings.groupBy(F.col("directory").alias("_at")).agg(F.min_by("text", "path").alias("sibling"))
    both = files.drop("sibling").join(first, F.col("directory") == F.col("_at"), "left").drop("_at")
    reason = F.when(F.col("sibling").isNull(), "no sibling").when(~F.coalesce(F.schema_of_variant(F.try_parse_json("sibling")).startswith("OBJECT"), F.lit(False)), "no object in it")
    both = both.withColumn("_reason", reason)
    return both.where("_reason IS NULL").drop("_reason"), both.where("_reason IS NOT NULL").select("path", F.col("_reason").alias("reason"))


def read_each(spark: SparkSession, inputs: dict[str, str], read) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of ``read(path)`` of each input with its name in ``config``, and the names that failed with the reason.

    An input fails here if its path is missing or its files have no schema; columns that only some of them have are null in the others. None: all failed.
    """
    got, failed = None, {}
    for name, path in inputs.items():
        try:
            one = read(path).withColumn("config", F.lit(name))
        except AnalysisException as e:
            failed[name] = e.getCondition() or "failed"
            continue
        got = one if got is None else got.unionByName(one, allowMissingColumns=True)
    return got, failed
