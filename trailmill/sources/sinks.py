"""Sinks that count: rows read, rows written, rows read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_both(rows: DataFrame, keep: Column, path: str, form: str = "json") -> tuple[str, str, dict[str, int]]:
    """One pass to two sinks: ``path`` with all rows, and the part of it in which ``keep`` holds (null: doesn't).

    The folder of kept rows lies inside of the whole, so no row is written twice and nothing is computed twice. Gives both paths and the counts
    that the write itself has seen. A column named kept is replaced by the partition's.
    """
    seen = Observation()
    flag = F.coalesce(keep, F.lit(False))
    out = rows.withColumn("kept", flag.cast("int")).observe(seen, F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    writer = out.write.partitionBy("kept").format(form)
    (writer.option("ignoreNullFields", False) if form == "json" else writer).save(path)
    return path, f"{path}/kept=1", {k: int(v) for k, v in seen.get.items()}


def rewrite(rows: DataFrame, source: str, target: str, written: Column | None = None, form: str = "json") -> dict[str, int]:
    """Writes ``rows`` (read from ``source`` and changed) to ``target`` and reads that again: counts of rows read, written, and read again.

    ``written``: the rows that are written; the others are read and left out. A target that is the source, or lies inside of it or around it, raises ValueError, and so does one that
    gives back another number of rows than were written: the source stays as it was either way.
    """
    a, b = (p.rstrip("/") + "/" for p in (source, target))
    if a.startswith(b) or b.startswith(a):
        raise ValueError("a rewrite needs a target outside of its source")
    read, wrote = Observation(), Observation()
    out = rows.observe(read, F.count(F.lit(1)).alias("n"))
    out = (out if written is None else out.where(F.coalesce(written, F.lit(False)))).observe(wrote, F.count(F.lit(1)).alias("n"))
    writer = out.write.format(form)
    (writer.option("ignoreNullFields", False) if form == "json" else writer).save(target)
    again = rows.sparkSession.read.schema(out.schema).format(form).load(target).count()
    counts = {"read": int(read.get["n"]), "written": int(wrote.get["n"]), "reread": again}
    if again != counts["written"]:
        raise ValueError(f"{counts['written']} rows were written and {again} are there")
    return counts


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary as one file of indented JSON: an array with an object for each row, keys in the order of the columns. For summaries, whose rows are few (a row for each dataset); Spark writes the file."""
    lines = F.array_join(F.transform(F.array(*(F.struct(F.lit(c).alias("k"), F.coalesce(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), F.lit("")).alias("v")) for c in summary.columns)), _member), ",\n")
    one = summary.select(F.concat(F.lit("  {\n"), lines, F.lit("\n  }")).alias("o"))
    whole = one.agg(F.array_join(F.array_sort(F.collect_list("o")), ",\n").alias("all"))
    whole.select(F.when(F.col("all") == "", "[]").otherwise(F.concat(F.lit("[\n"), F.col("all"), F.lit("\n]"))).alias("value")).coalesce(1).write.text(path)


def _member(field: Column) -> Column:
    """    "key": value, the value as JSON text cut out of ``{"v":value}``."""
    value = F.substr(field["v"], F.lit(6), F.length(field["v"]) - 6)
    return F.concat(F.lit('    "'), field["k"], F.lit('": '), value)
