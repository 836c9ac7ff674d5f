"""Row numbers over a whole table, with no task that holds all rows or a whole group.

Two passes: rows are range-partitioned by a total order, sorted, and written with their place in the partition; then
the partitions' counts, one row for each partition, give the offset that each partition's places begin at.

Equal rows have no order of their own, so any of them may come first; rows that tie in ``order`` are told apart by where
they were read, which only keeps them apart in the ranges: name a key last in ``order`` where the numbers must repeat.
Nulls sort first in ascending order, as in Spark. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.shared import stored

#: A place in a partition is what is left of monotonically_increasing_id below this bit.
PLACE = (1 << 33) - 1


def free(name: str, taken: list[str]) -> str:
    """A column name that is not taken yet."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def ranges(rows: DataFrame, order: list[Column], partitions: int | None = None, files: int | None = None) -> tuple[DataFrame, str, str]:
    """The rows in ranges of ``order``, stored, and the names of the columns with the range and the place in it (both new). ``files``: tasks that write, several ranges each."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, part, at = (free(x, rows.columns) for x in ("_tie", "_part", "_at"))
    kept = rows.withColumn(tie, F.monotonically_increasing_id())
    dealt = kept.repartitionByRange(n, *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie)
    own = F.monotonically_increasing_id()
    placed = dealt.withColumn(part, F.shiftright(own, 33).cast("int")).withColumn(at, own.bitwiseAND(F.lit(PLACE)))
    return stored(placed if files is None else placed.coalesce(files), "ranges"), part, at


def offsets(placed: DataFrame, part: str, amount: Column) -> DataFrame:
    """For each range what all ranges before it hold of ``amount`` (``before``): a row for each range, however large the table."""
    each = placed.groupBy(part).agg(amount.alias("_own"))
    return each.select(part, (F.sum("_own").over(W.orderBy(part)) - F.col("_own")).alias("before"))


def numbered(rows: DataFrame, order: list[Column], name: str = "number", partitions: int | None = None) -> DataFrame:
    """Adds ``name``: the row's place in the whole order, from 0. A column of that name is an error."""
    if name.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"there is a column {name} already")
    placed, part, at = ranges(rows, order, partitions)
    before = offsets(placed, part, F.count("*")).withColumnRenamed("before", f"{at}_before")
    return placed.join(F.broadcast(before), part).select(*rows.columns, (F.col(at) + F.col(f"{at}_before")).alias(name))


def numbered_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "number", partitions: int | None = None, files: int | None = None) -> DataFrame:
    """Adds ``name``: the row's place among the rows of equal ``by`` (nulls are equal), from 0.

    A group of any size lies in as many ranges as it needs. Its first number is the least of a row for each of its ranges,
    and rows meet it by group and range, so no key of that join holds more than a range.
    """
    whole, every = free("_number", rows.columns), free("_range", rows.columns)
    placed, part, at = ranges(rows, [*(F.col(b) for b in by), *order], partitions, files)
    before = offsets(placed, part, F.count("*")).withColumnRenamed("before", f"{at}_before")
    known = placed.join(F.broadcast(before), part).withColumn(whole, F.col(at) + F.col(f"{at}_before")).drop(at, f"{at}_before").withColumnRenamed(part, every)
    keys = [(b, f"{whole}_{i}") for i, b in enumerate(by)]
    first = known.groupBy(every, *by).agg(F.min(whole).alias(f"{whole}_own")).withColumn(f"{whole}_first", F.min(f"{whole}_own").over(W.partitionBy(*by)))
    first = first.select(F.col(every).alias(f"{every}_f"), *(F.col(b).alias(k) for b, k in keys), f"{whole}_first")
    same = F.col(every) == F.col(f"{every}_f")
    for b, k in keys:
        same &= F.col(b).eqNullSafe(F.col(k))
    return known.join(first, same).select(*rows.columns, (F.col(whole) - F.col(f"{whole}_first")).alias(name))


def rows_at(rows: DataFrame, order: list[Column], first: int, last: int, name: str = "number") -> DataFrame:
    """Rows number ``first`` to ``last`` (from 0, end exclusive) of the whole order, at any depth: no task sorts more than a range."""
    return numbered(rows, order, name).where((F.col(name) >= first) & (F.col(name) < last))


def write_in_order(rows: DataFrame, order: list[Column], path: str, partitions: int | None = None) -> None:
    """Parquet files whose concatenation by name is the rows in order: each task writes one range, and no file is joined to another."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(path)


def read_in_order(spark: SparkSession, path: str, name: str = "number") -> DataFrame:
    """The rows of such files with ``name``, their place in the concatenation: rows of the files before, and the place in the file."""
    rows = spark.read.parquet(path)
    columns = rows.columns
    file, at = free("_file", columns), free("_at", columns)
    placed = rows.select(*columns, F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
    before = offsets(placed, file, F.count("*")).withColumnRenamed("before", f"{at}_before")
    return placed.join(F.broadcast(before), file).select(*columns, (F.col(at) + F.col(f"{at}_before")).alias(name))
