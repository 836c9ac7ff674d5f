"""Benchmark decontamination by template windows.

Tokens are split at white space, stripped of marks and lower-cased; numbers, units of measure and names
(capitalised words inside a sentence) become typed placeholders. Windows of ``WINDOW`` template tokens of a
text are hash-joined with those of the benchmark (an item that is shorter is one window, and every text has windows
of that size too). So a question with other numbers or names still meets its original. A window with more slots
than words says too little as a template and is joined by its very values. Then slots are checked: where a text takes
an item's windows, each slot value of the item must stand for one value; if it doesn't, only windows with the very
same slot values count. This is judged over the whole text, and over each occurrence: the windows at one distance from
their places in the item, or at distances that follow each other by at most ``SHIFT`` tokens (words put in or left out).

A text leaks an item if any of these holds ``LEAST_COVER`` of all the item's windows or of those that aren't joined by
values (which other values leave no trace of), or if it has ``LITERAL_RUN`` tokens of the
item in a row with the same slot values, whatever share they are. Result: a row for each such (doc_id, item_id), with
the figures of the whole text or of the occurrence that holds more. Null text or item: empty; items of fewer than ``SHORTEST`` tokens have no windows.
Repeated doc_ids or item_ids are taken as one. Empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.llm.common import WordTable, arrow, mix, out, pieces, raw, stored, table, windows

WINDOW, SHORTEST = 8, 5
LEAST_COVER, LEAST_AGREEMENT = 0.3, 0.8
LITERAL_RUN, SHIFT = 13, 4
#: Most distinct benchmark windows that are shipped to every task (8 bytes each); beyond it windows are joined by shuffle.
SHIPPED = 1_000_000
#: Units of measure.
UNITS = frozenset(w.encode() for w in "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent $ dollar dollars € euro euros £ pound pounds cent cents mph kmh degrees".split())
MARKS = b" .,;:!?\"'()[]{}|*#&<>_-"
NUMBER = re.compile(rb"[$+-]?\d[\d.,/]*(?:st|nd|rd|th|%)?")
NAME, NUMERAL, UNIT = 3, 1, 2
SLOT = mix(np.arange(0, 4, dtype=np.uint64) + np.uint64(1))


def describe(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hash of the bare word, its kind without regard to what stands before it, whether it is capitalised, whether it ends a sentence."""
    n = len(words)
    kind, capital, ends, bares = np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool), []
    for i, w in enumerate(words):
        bare = w.strip(MARKS)
        if bare.isascii():
            low = bare.lower()
            if low != bare:
                capital[i] = bare[0] != low[0] and not bare[1:2].isupper()
        else:
            text = bare.decode("utf-8", "replace")
            capital[i], low = text[:1].isupper() and not text.isupper(), text.lower().encode()
        bares.append(low)
        if low[:1] in b"0123456789$+-" and NUMBER.fullmatch(low):
            kind[i] = NUMERAL
        elif (low or w) in UNITS:
            kind[i] = UNIT
        ends[i] = w[-1] in b".!?:|"
    return np.fromiter(map(xxhash.xxh3_64_intdigest, bares), np.uint64, n), kind, capital, ends


def templates(texts: list[bytes], words: WordTable):
    """Of all texts in a row: value, kind and template hash of each token, and where each text begins (and the end)."""
    split = [t.split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])])
    value, kind, capital, ends = words.look([w for s in split for w in s])
    begins = np.concatenate([[True], ends[:-1]]) if len(ends) else ends
    begins[starts[:-1][starts[:-1] < len(begins)]] = True  # the first word of a text begins a sentence
    kind = np.where((kind == 0) & capital & ~begins, NAME, kind)
    return value.view(np.int64), kind, np.where(kind > 0, SLOT[kind], value), starts


def window_hashes(value: np.ndarray, kind: np.ndarray, shape: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window's template; of one that has more slots than words, of its values and their kinds."""
    w = windows(shape, size)
    if len(w):
        slots = np.concatenate([[0], np.cumsum(kind > 0)])
        heavy = np.flatnonzero(slots[size:] - slots[:-size] > size // 2)
        both = (value.view(np.uint64) + shape)[heavy[:, None] + np.arange(size)]
        w[heavy] = windows(both.ravel(), size)[::size] if len(heavy) else 0
    return w.view(np.int64)


#: What a verdict is taken over: the whole text, an occurrence with words put in or left out, an exact one.
WHOLE, NEAR, EXACT = 0, 1, 2
WINDOWS = "id long, h long, at int, size int, values array<long>"


def text_windows(rows: DataFrame, sizes=None, wanted=None) -> DataFrame:
    """Windows of (id, text) rows: id, h, at, size, values (of slots; 0 elsewhere). ``sizes``: those that every text is
    cut by; None: the rows are items, each cut by its own size, and a capitalised first word also gives its first window with a
    name there, as in the middle of a sentence. ``wanted``: a shipped sorted array of (hash) that others are left out by."""

    def run(batches):
        to, words = arrow(WINDOWS), WordTable(describe)
        keep = wanted.value if wanted is not None else None
        if keep is not None:
            mask = np.zeros(1 << 22, bool)
            mask[keep & (len(mask) - 1)] = True
        for b in pieces(batches):
            texts = raw(b)
            value, kind, shape, starts = templates(texts, words)
            own = np.minimum(np.diff(starts), WINDOW)
            views = [(kind, shape, None)]
            if sizes is None:
                first = starts[:-1][own > 0]
                named = first[(kind[first] == 0) & words.look([t.split(None, 1)[0] for t, n in zip(texts, own, strict=True) if n])[2]]
                kind_2, shape_2 = kind.copy(), shape.copy()
                kind_2[named], shape_2[named] = NAME, SLOT[NAME]
                views.append((kind_2, shape_2, named))
            for kind, shape, only in views:
                for size in range(SHORTEST, WINDOW + 1) if sizes is None else sizes:
                    w = window_hashes(value, kind, shape, size)
                    at = np.arange(len(w)) if keep is None else np.flatnonzero(mask[w & (len(mask) - 1)])
                    at = at if keep is None else at[np.isin(w[at], keep)]
                    at = at if only is None else np.intersect1d(at, only)
                    text = np.searchsorted(starts, at, "right") - 1
                    inside = at + size <= starts[text + 1]  # a window lies within one text
                    inside &= own[text] == size if sizes is None else True
                    at, text = at[inside], text[inside]
                    if len(at):
                        where = at[:, None] + np.arange(size)
                        values = np.where(kind[where] > 0, value[where], 0).ravel()
                        ends = np.arange(len(at) + 1, dtype=np.int32) * size
                        yield out(to, b.column("id").take(pa.array(text)), w[at], (at - starts[text]).astype(np.int32), np.full(len(at), size, np.int32), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))

    return rows.mapInArrow(run, WINDOWS)


def leaks(docs: DataFrame, bench: DataFrame, shipped: int = SHIPPED, least_cover: float = LEAST_COVER) -> DataFrame:
    """doc_id, item_id, cover (share of the item's windows found), agreement (of slots), literal (share with the same slot values)."""
    spark = docs.sparkSession
    items = bench.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(F.col("item_id").alias("id"), "text")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where("id IS NOT NULL")
    wanted = stored(text_windows(items), "windows")  # a benchmark is read by five parts of the answer
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]  # at most four
    size = wanted.select("h").distinct().count()
    if size <= shipped:
        keep = np.sort(np.array(wanted.select("h").distinct().toPandas()["h"], np.int64))  # at most ``shipped`` rows
        found = text_windows(rows, sizes, wanted=spark.sparkContext.broadcast(keep))
    else:
        found = text_windows(rows, sizes)
    light = F.size(F.filter("own", lambda v: v != 0)) <= F.floor(F.col("size") / 2)  # joined by template
    total = wanted.withColumn("own", F.col("values")).groupBy("id").agg(F.count_distinct("at").alias("total"), F.count_distinct(F.when(light, F.col("at"))).alias("total_light"))
    hit = found.join(wanted.select("h", "size", F.col("id").alias("item_id"), F.col("at").alias("place"), F.col("values").alias("own")), ["h", "size"])
    pair = ["doc_id", "item_id"]
    same = stored(hit.select(F.col("id").alias("doc_id"), "item_id", "place", (F.col("at") - F.col("place")).alias("far"), (F.col("values") == F.col("own")).alias("same"), light.alias("light"), "own", "values"), "hits")
    by_far = W.partitionBy(*pair).orderBy("far")
    apart = same.withColumn("new", (F.col("far") - F.lag("far").over(by_far) > SHIFT).cast("int")).withColumn("run", F.coalesce(F.sum("new").over(by_far), F.lit(0)))
    scopes = [(WHOLE, F.lit(0)), (NEAR, F.col("run")), (EXACT, F.col("far"))]
    each = apart.withColumn("in", F.explode(F.array(*(F.struct(F.lit(k).alias("scope"), c.cast("long").alias("part")) for k, c in scopes)))).select(*pair, "in.*", "place", "same", "light", "own", "values")
    key = [*pair, "scope", "part"]
    places = each.groupBy(*key, "place").agg(F.max("same").alias("same"), F.max("light").alias("light"))
    cover = places.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"), F.count_if("light").alias("n_light"), F.count_if(F.col("same") & F.col("light")).alias("n_same_light"))
    slots = each.select(*key, F.explode(F.arrays_zip("own", "values")).alias("s")).where("s.own <> 0").select(*key, "s.own", "s.values").distinct()
    agree = slots.groupBy(*key).agg((F.count_distinct("own") / F.count("*")).alias("agreement"))
    share = lambda n: F.greatest(F.col(n) / F.col("total"), F.try_divide(F.col(f"{n}_light"), F.col("total_light"))).alias({"n": "cover", "n_same": "literal"}[n])
    shares = [share("n"), F.coalesce("agreement", F.lit(1.0)).alias("agreement"), share("n_same")]
    judged = cover.join(agree, key, "left").join(total.withColumnRenamed("id", "item_id"), "item_id").select(*key, *shares)
    held = F.when(F.col("agreement") >= LEAST_AGREEMENT, F.col("cover")).otherwise(F.col("literal")).alias("held")
    best = judged.groupBy(*pair).agg(F.max(F.struct(held, (-F.col("scope")).alias("wide"), "cover", "agreement", "literal")).alias("b"))
    in_row = places.where(f"same AND scope = {EXACT}").withColumn("row", F.col("place") - F.row_number().over(W.partitionBy(*key).orderBy("place")))
    copied = in_row.groupBy(*key, "row").agg(F.count("*").alias("n")).where(F.col("n") > LITERAL_RUN - WINDOW).select(*pair, F.lit(True).alias("copied")).distinct()
    return best.join(copied, pair, "left").where((F.col("b.held") >= least_cover) | F.col("copied")).select(*pair, "b.cover", "b.agreement", "b.literal")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
