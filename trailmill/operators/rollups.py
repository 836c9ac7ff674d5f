"""Evaluation roll-ups. Means of nothing are 0.0, not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def win_rate(rows: DataFrame, won: Column, by: list[str]) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(*by).agg(F.count_if(won).alias("n_won"), n.alias("n"), (F.count_if(won) / F.greatest(n, F.lit(1))).alias("win_rate"))


def top_reasons(rows: DataFrame, reason: Column, k: int = 5) -> DataFrame:
    """The k most frequent reasons (none: completed), ties by name."""
    return rows.groupBy(F.coalesce(F.nullif(reason, F.lit("")), F.lit("completed")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def scores(rows: DataFrame, score: Column, steps: Column, by: list[str]) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), (F.coalesce(F.sum(score), F.lit(0.0)) / n).alias("mean_score"), (F.count_if(score >= 100) / n).alias("full_rate"), (F.count_if(score >= 50) / n).alias("partial_rate"), (F.coalesce(F.sum(steps), F.lit(0)) / n).alias("mean_steps"),
    )


def lengths(rows: DataFrame, text: Column, by: list[str]) -> DataFrame:
    size = F.length(text).cast("long")
    return rows.groupBy(*by).agg(F.min(size).alias("shortest"), F.max(size).alias("longest"), F.expr("1").alias("_one"), F.floor(F.sum(size) / F.count("*")).cast("long").alias("mean_floor")).drop("_one")
