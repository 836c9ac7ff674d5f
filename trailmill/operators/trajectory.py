"""Loops, streaks and diversity in action sequences. Every window has a total order within its trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOOP, STREAK, RECENT = 3, 4, 20


def turns(key: str, order: list[str]):
    return W.partitionBy(key).orderBy(*order)


def loop_flags(rows: DataFrame, key: str, order: list[str], action: str, nothing: Column) -> DataFrame:
    """Adds aaa, abab, streak (of nothing so far), recent (distinct actions of the last 20, null before there are 20), n (turn from 1).

    All windows share one partitioning and order: one shuffle, one sort. A null ``nothing`` counts as something.
    """
    w = turns(key, order)
    a = F.col(action)
    flagged = rows.withColumns({
        "n": F.row_number().over(w), "_a1": F.lag(a, 1).over(w), "_a2": F.lag(a, 2).over(w), "_a3": F.lag(a, 3).over(w),
        "_nothing": F.coalesce(nothing, F.lit(False)),
        "recent": F.size(F.collect_set(a).over(w.rowsBetween(1 - RECENT, 0))),
    })
    return flagged.withColumns({
        "aaa": F.coalesce((a == F.col("_a1")) & (a == F.col("_a2")), F.lit(False)),
        "abab": F.coalesce((a == F.col("_a2")) & (F.col("_a1") == F.col("_a3")) & (a != F.col("_a1")), F.lit(False)),
        "recent": F.when(F.col("n") >= RECENT, F.col("recent")),
        "streak": (F.col("n") - F.coalesce(F.max(F.when(~F.col("_nothing"), F.col("n"))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).cast("long"),
    }).drop("_a1", "_a2", "_a3", "_nothing")


def kill_reason(flags: DataFrame, rule: str = "rollout") -> Column:
    """Why an episode ends at a turn, null if it goes on. Rules differ by harness:

    rollout  loop (AAA, ABAB, at most 3 distinct of 20), stuck (4 times nothing)
    eval     loop (AAA), stuck
    fast     loop (AAA), loop_abab, stuck
    science  loop (AAA, ABAB, fewer than 5 distinct of 20)
    """
    aaa, abab, few, stuck = flags["aaa"], flags["abab"], flags["recent"], flags["streak"] >= STREAK
    if rule == "rollout":
        return F.when(aaa | abab | F.coalesce(few <= 3, F.lit(False)), "loop").when(stuck, "stuck")
    if rule == "eval":
        return F.when(aaa, "loop").when(stuck, "stuck")
    if rule == "fast":
        return F.when(aaa, "loop").when(abab, "loop_abab").when(stuck, "stuck")
    if rule == "science":
        return F.when(aaa | abab | F.coalesce(few < 5, F.lit(False)), "loop")
    raise ValueError(f"unknown rule {rule}")


def truncate(rows: DataFrame, key: str, n: str, terminal: Column) -> DataFrame:
    """Turns up to the first terminal one, included."""
    return rows.withColumn("_end", F.min(F.when(terminal, F.col(n))).over(W.partitionBy(key))).where(F.col("_end").isNull() | (F.col(n) <= F.col("_end"))).drop("_end")


def runs(rows: DataFrame, key: str, order: list[str], action: str) -> DataFrame:
    """key, action, length: a row for each maximal run of one action."""
    w = turns(key, order)
    island = F.row_number().over(w) - F.row_number().over(W.partitionBy(key, action).orderBy(*order))
    return rows.withColumn("_island", island).groupBy(key, action, "_island").agg(F.count("*").alias("length")).drop("_island")


def quality(rows: DataFrame, key: str, order: list[str], action: str, nothing: Column) -> DataFrame:
    """n_actions, n_nothing, max_repeat (1 at least), max_nothing_streak, n_aaa, n_abab of each trajectory."""
    flags = loop_flags(rows, key, order, action, nothing)
    longest = runs(rows.where(F.col(action).isNotNull()), key, order, action).groupBy(key).agg(F.max("length").alias("longest"))
    own = flags.groupBy(key).agg(F.count(action).alias("n_actions"), F.count_if(nothing).alias("n_nothing"), F.max("streak").alias("max_nothing_streak"), F.count_if("aaa").alias("n_aaa"), F.count_if("abab").alias("n_abab"))
    return own.join(longest, key, "left").select(key, "n_actions", "n_nothing", F.greatest(F.coalesce("longest", F.lit(1)), F.lit(1)).cast("long").alias("max_repeat"), "max_nothing_streak", "n_aaa", "n_abab")


def repeated_call(rows: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """Adds repeated: the call before had the same signature."""
    return rows.withColumn("repeated", F.coalesce(F.col(signature) == F.lag(signature).over(turns(key, order)), F.lit(False)))


def first_seen(rows: DataFrame, key: str, order: list[str], text: Column, prefix: int = 200) -> DataFrame:
    """Adds first: no earlier row of the trajectory begins with the same characters."""
    return rows.withColumn("_p", F.left(text, F.lit(prefix))).withColumn("first", F.row_number().over(W.partitionBy(key, "_p").orderBy(*order)) == 1).drop("_p")


def preceding(rows: DataFrame, key: str, order: list[str], wanted: Column, value: Column) -> Column:
    """The nearest earlier value among rows that ``wanted`` holds for."""
    return F.last(F.when(wanted, value), ignorenulls=True).over(turns(key, order).rowsBetween(W.unboundedPreceding, -1))


def running_mean(rows: DataFrame, key: str, order: list[str], value: Column) -> Column:
    return F.avg(value).over(turns(key, order).rowsBetween(W.unboundedPreceding, 0))


def response_class(text: Column) -> Column:
    """empty, error, data (over 50 characters, or an id or a title), else success."""
    low = F.lower(F.coalesce(text, F.lit("")))
    error = F.contains(low, F.lit('"error"')) | F.contains(low, F.lit("execution failed")) | F.contains(low, F.lit("traceback"))
    return F.when(low.rlike(r"(?U)\A\s*\z"), "empty").when(error, "error").when((F.length(low) > 50) | F.contains(low, F.lit('"id"')) | F.contains(low, F.lit('"title"')), "data").otherwise("success")
