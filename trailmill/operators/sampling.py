"""Deterministic samples, caps, shards and splits. A seeded hash takes the place of a seeded shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.operators import ordering


def shuffle_key(*ids: str, seed: int = 7) -> Column:
    """A pseudo-random order that any engine can repeat: md5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def stratified_cap(rows: DataFrame, stratum: str, ids: list[str], per_stratum: int, total: int, seed: int = 7) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum, ``total`` in all, by shuffle order. The rank limit is applied before the shuffle too."""
    key = shuffle_key(*ids, seed=seed)
    ranked = rows.withColumn("_k", key).withColumn("_n", F.row_number().over(W.partitionBy(stratum).orderBy("_k", *ids))).where(F.col("_n") <= per_stratum)
    return ranked.orderBy("_k", *ids).limit(total).drop("_k", "_n")


def shard(rows: DataFrame, ids: list[str], n: int, seed: int = 7) -> DataFrame:
    """Adds shard 0..n-1 by hash: even in the mean, and no sort of the whole table."""
    return rows.withColumn("shard", F.pmod(F.conv(F.left(shuffle_key(*ids, seed=seed), F.lit(8)), 16, 10).cast("bigint"), F.lit(n)).cast("int"))


def round_robin(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """Adds shard: place in the group modulo n, i.e. rows k, k + n, k + 2n ... go together. A group of any size is numbered by many tasks. A column of that name is replaced."""
    placed = ordering.numbered_within(rows.drop("shard"), [by], [F.col(c) for c in order], "shard")
    return placed.withColumn("shard", F.pmod("shard", F.lit(n)).cast("int"))


def length_batches(rows: DataFrame, by: str, length: Column, ids: list[str], size: int) -> DataFrame:
    """Adds batch: rows of a shard by length, then cut into batches of ``size``; as above. A column of that name is replaced."""
    placed = ordering.numbered_within(rows.drop("batch"), [by], [length, *(F.col(c) for c in ids)], "batch")
    return placed.withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def kept_in_order(rows: DataFrame, kept: Column, order: list[Column], length: Column, budget: int) -> DataFrame:
    """The rows that are kept, with ``index``, their place among them in the source's order, and ``overlong``, whether their length passes the budget (a null length doesn't)."""
    placed = ordering.numbered(rows.where(kept).drop("index", "overlong"), order, "index")
    return placed.withColumn("overlong", F.coalesce(length > budget, F.lit(False)))


def prefix(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order that ends in a key; all rows where n is zero or less. A top-k in each task, then one merge."""
    return rows.orderBy(*order).limit(n) if n > 0 else rows


def split(rows: DataFrame, group: Column, train: float = 0.8, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split by a hash of the group, so no group is in two splits."""
    u = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), group)), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + test, "test").otherwise("eval"))


def leaks(split_rows: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one split: none, if the split is right."""
    return split_rows.groupBy(group).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def disjoint(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    return test.join(train.select(*keys).distinct(), keys, "left_anti")
