"""Substring dedup by hashing lines.

A text's units are its lines, cut again after a full stop, exclamation or question mark and a space, since passages are
also pasted into the middle of lines. A unit's key is its normalised form (trimmed, lower case, runs of white
space as one space); a unit of fewer than ``LEAST_WORDS`` words is too common by chance and is keyed together with the
unit before it, so it counts as repeated only where that neighbour is the same too. Keys are
hashed to 128 bits and grouped over the whole corpus; the occurrence with the least (doc_id, offset) stays, every
other one is removed. Offsets are code points of the original text, end exclusive (without the newline or space after).

Null text: empty. Blank units, and short units whose pair is short, are never removed. A unit that repeats
within a text is removed there too. Rows that share a doc_id are one document with several texts: equal
rows are the same occurrence, so they change nothing. A null doc_id ranks after all others. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import arrow, id_and_text, out, pieces, table

LEAST_WORDS = 8
ENDS = (". ", "! ", "? ")
UNITS = "doc_id long, start long, stop long, n_words int, hi long, lo long"


def units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, stop, n_words and the 128-bit key of each unit that has one."""

    def run(batches):
        to = arrow(UNITS)
        for b in pieces(batches):
            ids, starts, stops, counts, keys = [], [], [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                at, before = 0, []
                for mark in ENDS:
                    text = text.replace(mark, f"{mark[0]}\n")  # of equal length: offsets stay
                for line in text.split("\n"):
                    words = line.lower().split()
                    n = len(words)
                    key = words if n >= least_words else [*before, "\n", *words] if n and len(before) + n >= least_words else None
                    if key:
                        ids.append(i)
                        starts.append(at)
                        stops.append(at + len(line))
                        counts.append(n)
                        keys.append(hashlib.blake2b(" ".join(key).encode(), digest_size=16).digest())
                    at, before = at + len(line) + 1, words
            if ids:
                both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield out(to, ids, starts, stops, np.array(counts, np.int32), both[:, 0], both[:, 1])

    return id_and_text(docs).mapInArrow(run, UNITS)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each removed unit: doc_id, start, stop, n_words, kept_doc_id, kept_start.

    The group by key is partly done before the shuffle, so a line found everywhere sends a row for each task;
    the join back is a plain equi-join, whose hot keys Spark splits at run time.
    """
    found = units(docs, least_words)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    first = found.groupBy("hi", "lo").agg(F.min(place).alias("kept"), F.max(place).alias("other")).where("kept <> other")  # equal rows are one place
    gone = found.join(first, ["hi", "lo"]).where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("start") == F.col("kept.start")))).distinct()
    return gone.select("doc_id", "start", "stop", "n_words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))


def cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, text without the removed units (and their newlines), removed: the original offsets, in order."""
    spans = gone.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("removed"))
    joined = id_and_text(docs).join(spans, "doc_id", "left")
    left = F.aggregate(
        F.coalesce("removed", F.expr("array()").cast("array<struct<start:long,stop:long>>")), F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["done"], F.substr("text", (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))).alias("done"), (s["stop"] + 1).alias("at")),
        lambda acc: F.concat(acc["done"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))),
    )
    return joined.select("doc_id", left.alias("text"), "removed")


def op7_linedup(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH lines AS (
  SELECT DISTINCT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i, t
  FROM (SELECT doc_id, replace(replace(replace(coalesce(text, ''), '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)) AS t FROM documents)),
placed AS (
  SELECT doc_id, i, t, line, sum(length(line) + 1) OVER (PARTITION BY doc_id, t ORDER BY i) - length(line) - 1 AS start,
    list_filter(string_split_regex(lower(line), '\\s+'), lambda w: w <> '') AS words FROM lines),
near AS (
  SELECT *, len(words) AS n, lag(words) OVER (PARTITION BY doc_id, t ORDER BY i) AS before FROM placed),
keyed AS (
  SELECT doc_id, start, start + length(line) AS stop, n,
    CASE WHEN n >= 8 THEN list_aggregate(words, 'string_agg', ' ')
         WHEN n > 0 AND coalesce(len(before), 0) + n >= 8 THEN list_aggregate(before, 'string_agg', ' ') || ' ' || chr(10) || ' ' || list_aggregate(words, 'string_agg', ' ') END AS key
  FROM near),
found AS (SELECT DISTINCT doc_id, start, stop, n, key FROM keyed WHERE key IS NOT NULL),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start FROM found
  WINDOW w AS (PARTITION BY key ORDER BY doc_id NULLS LAST, start))
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(n AS INTEGER) AS n_words, kept_doc_id, CAST(kept_start AS BIGINT) AS kept_start
FROM ranked WHERE doc_id <> kept_doc_id OR start <> kept_start
"""
