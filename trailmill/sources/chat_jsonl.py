"""Lenient chat JSONL: rows that are not chats are dropped and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.operators.chat import MESSAGES, prune


def chat_of(line: Column, passthrough: bool = False) -> Column:
    """The messages of a line, wrapped as {"messages": [...]} or a bare array; null if it is neither.

    ``passthrough`` takes bare arrays only. A message must have a role and a content; a text in place of the
    array is not one.
    """
    bare = F.from_json(line, MESSAGES)
    wrapped = F.from_json(line, f"messages {MESSAGES}")["messages"]
    text = F.ltrim(line)
    got = F.when(F.startswith(text, F.lit("[")), bare)
    if not passthrough:
        got = got.when(F.startswith(text, F.lit("{")), wrapped)
    whole = (F.size(got) > 0) & F.forall(got, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), prune(got))


def read(spark: SparkSession, path: str, passthrough: bool = False) -> DataFrame:
    """line, messages (null: skipped); count both with ``counters``."""
    return spark.read.text(path).select(F.col("value").alias("line"), chat_of(F.col("value"), passthrough).alias("messages"))


def counters(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_in"), F.count("messages").alias("n_out"), F.count_if(F.col("messages").isNull()).alias("n_skipped"))


def decode_either(messages: Column) -> Column:
    """Messages from a column that holds either JSON of the array or JSON of a text that is JSON of the array."""
    inner = F.from_json(F.concat(F.lit('{"m":'), messages, F.lit("}")), "m string")["m"]
    return F.from_json(F.coalesce(inner, messages), MESSAGES)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """index, config, prediction, reference; other names of both columns are taken where the first is missing."""
    schema = "index bigint, config string, prediction_raw string, predicted string, generated string, reference string, expected string, ground_truth string, skipped_overlong boolean"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.select("index", "config", F.coalesce("prediction_raw", "predicted", "generated", F.lit("")).alias("prediction"), F.coalesce("reference", "expected", "ground_truth", F.lit("")).alias("reference"), F.coalesce("skipped_overlong", F.lit(False)).alias("overlong"))


def read_present(spark: SparkSession, pattern: str, names: list[str], read_one) -> DataFrame | None:
    """Union of the files that exist, each tagged with its name; a missing one is skipped. Existence is asked of the store itself."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    got = None
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(pattern.format(name=name))
        if path.getFileSystem(conf).exists(path):
            one = read_one(spark, path.toString()).withColumn("dataset", F.lit(name))
            got = one if got is None else got.unionByName(one)
    return got


def write_chats(chats: DataFrame, path: str, bare: bool = False, shards: int | None = None) -> None:
    """One chat a line; nulls are written, as in Python. Shards are Spark's own part files."""
    line = F.to_json("messages", {"ignoreNullFields": "false"}) if bare else F.to_json(F.struct("messages"), {"ignoreNullFields": "false"})
    out = chats.select(line.alias("value"))
    (out.repartition(shards) if shards else out).write.text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only event log with its fields cut to fixed lengths."""
    rows.select("rid", "turn", "action", F.left("obs", F.lit(240)).alias("obs"), "won", "via").write.mode("append").json(path)
