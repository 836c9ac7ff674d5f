"""Hashed byte n-grams of whole texts, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

from trailmill.llm.common import flat, sums

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def grams(data: np.ndarray, sizes: range, bits: int):
    """For each size: bucket of the n-gram that begins at each byte, and whether it counts.

    An n-gram counts if white space stands at most at its two ends, so each stays within one word.
    """
    blank = SPACE[data]
    h = np.zeros(len(data), np.uint32)
    inner = np.ones(len(data), bool)
    for n in range(1, sizes.stop):
        m = len(data) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) ^ data[n - 1 :].astype(np.uint32)
        if n >= 3:
            inner = inner[:m] & ~blank[n - 2 : n - 2 + m]
        if n in sizes:
            x = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            yield x >> np.uint32(32 - bits), inner[:m] & ~(blank[:m] & blank[n - 1 :])


def averages(texts: list[bytes], weight: np.ndarray, sizes: range, bits: int, fold: bool = True) -> np.ndarray:
    """Mean of weight[bucket] over all n-grams of each text; 0 where there are none."""
    data, starts = flat(texts)
    data = LOWER[data] if fold else data
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, counts in grams(data, sizes, bits):
        ends = np.minimum(starts, len(bucket))
        total += sums(np.where(counts, weight[bucket], 0), ends)
        count += sums(counts, ends)
    return total / np.maximum(count, 1)


def bag(text: bytes, sizes: range, bits: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text and the share of its n-grams in each."""
    data, _ = flat([text])
    data = LOWER[data] if fold else data
    found = [b[c] for b, c in grams(data, sizes, bits)]
    buckets, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
    return buckets.astype(np.int64), counts / max(counts.sum(), 1)
