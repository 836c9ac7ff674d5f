"""Predictions against references: one row for each kept prediction, drop reasons, means by dataset."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.jsonx import canonical, semantic_equal
from trailmill.functions.text import strip_tags

WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order that must be total; null keys are one key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def drop_reason(prediction: Column, reference_clean: Column, overlong: Column | None = None) -> Column:
    """Why a row is not scored, null if it is. The first reason that holds counts, so a row counts once."""
    reason = F.when(F.coalesce(overlong, F.lit(False)), "overlong") if overlong is not None else F
    return reason.when(F.startswith(F.coalesce(prediction, F.lit("")), F.lit("ERROR")), "error").when(F.coalesce(reference_clean, F.lit("")).rlike(r"(?U)\A\s*\z"), "empty_reference")


def clean(text: Column, profile: str) -> Column:
    return canonical(strip_tags(text, profile), spaced=profile == "ar")


def score(rows: DataFrame, profile: str = "block", overlong: Column | None = None) -> DataFrame:
    """rows with prediction, reference -> prediction_clean, reference_clean, reason, exact, semantic. ``overlong``: rows that were never asked for, which count as such before anything else."""
    both = rows.withColumns({"prediction_clean": clean(F.col("prediction"), profile), "reference_clean": clean(F.col("reference"), profile) if profile != "ar" else F.col("reference")})
    return both.withColumn("reason", drop_reason(F.col("prediction"), F.col("reference_clean"), overlong)).withColumns({"exact": F.col("prediction_clean") == F.col("reference_clean"), "semantic": semantic_equal("prediction_clean", "reference_clean")})


def summary(scored: DataFrame, by: str, rouge: str | None = None) -> DataFrame:
    """num_samples, exact_match, semantic_match (0.0 where nothing is scored), and what was dropped, for each dataset.

    ``rouge``: a column of ROUGE-L F1, whose mean over the scored rows is rouge_l_f1; without one there is no such column, nor one of overlong rows.
    """
    kept = F.col("reason").isNull()
    n = F.greatest(F.count_if(kept), F.lit(1))
    more = [] if rouge is None else [(F.coalesce(F.sum(F.when(kept, F.col(rouge))), F.lit(0.0)) / n).alias("rouge_l_f1"), F.count_if(F.col("reason") == "overlong").alias("num_skipped_overlong")]
    return scored.groupBy(by).agg(
        *more,
        F.count_if(kept).alias("num_samples"), (F.count_if(kept & F.col("exact")) / n).alias("exact_match"), (F.count_if(kept & F.col("semantic")) / n).alias("semantic_match"),
        F.count_if(F.col("reason") == "error").alias("num_dropped_errors"), F.count_if(F.col("reason") == "empty_reference").alias("num_empty_ref_dropped"),
    )


#: Bytes of word masks that are kept while two texts are compared; masks beyond it are made again for each occurrence.
MASK_BYTES = 64_000_000


def lcs_length(a: list[str], b: list[str], most: int = MASK_BYTES) -> int:
    """Length of the longest common subsequence. A row of the table is one integer, a bit for each word of ``b``; the masks of words are kept within ``most`` bytes."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(b):
        at.setdefault(w, []).append(i)
    masks: dict[str, int] = {}
    size, room = len(b) // 8 + 1, most // (len(b) // 8 + 64)

    def mask(w: str) -> int:
        bits = bytearray(size)
        for i in at[w]:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    row = every = (1 << len(b)) - 1
    for w in a:
        if w in at:
            if (own := masks.get(w)) is None:
                own = mask(w)
                if len(masks) < room:
                    masks[w] = own
            met = row & own
            row = (row + met | row - met) & every
    return len(b) - row.bit_count()


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of the lower-cased words of whole texts; 0.0 where either side has none or is null."""

    @F.pandas_udf("double")
    def f1(a: pd.Series, b: pd.Series) -> pd.Series:
        words = ([WORD.findall(x or "") for x in side] for side in (a, b))
        return pd.Series([2.0 * lcs_length(p, r) / (len(p) + len(r)) if p and r else 0.0 for p, r in zip(*words, strict=True)], dtype="float64")

    return f1(F.lower(prediction), F.lower(reference))
