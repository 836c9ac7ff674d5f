"""Elias-Fano coding of monotone integers, with vectorised access, as flat arrays that can be memory-mapped."""

from __future__ import annotations

import numpy as np

ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: SELECT[b, k]: place of the k-th one in byte b.
SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        SELECT[_b, _k] = _p


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """low: the low bytes as they are; high: the rest in unary, a one for each value; seen: ones before each 64 bits."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    spare = max(top // max(n, 1), 1).bit_length() - 1
    width = -(-spare // 8)  # low bytes for each value
    v = values.astype(np.uint64)
    low = v.view(np.uint8).reshape(n, 8)[:, :width].copy() if n else np.zeros((0, width), np.uint8)
    at = (v >> np.uint64(8 * width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(-(-(int(at[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
    bits[at] = 1
    high = np.packbits(bits, bitorder="little")
    seen = np.concatenate([[0], np.cumsum(ONES[high].reshape(-1, 8).sum(1))]).astype(np.int64)
    return {"low": low, "high": high, "seen": seen}


def get(code: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    """Values at places i."""
    if not len(i):
        return np.zeros(0, np.int64)
    block = np.searchsorted(code["seen"], i, "right") - 1
    left, byte = i - code["seen"][block], block * 8
    rest = code["high"].view("<u8")[block]
    for bits in (32, 16, 8):  # into the half that has the one, all queries together
        half = rest & np.uint64((1 << bits) - 1)
        ones = np.bitwise_count(half).astype(np.int64)
        later = left >= ones
        left, byte = left - later * ones, byte + later * (bits // 8)
        rest = np.where(later, rest >> np.uint64(bits), half)
    high = byte * 8 + SELECT[rest.astype(np.int64), left] - i
    width = code["low"].shape[1]
    for k in reversed(range(width)):
        high = high << 8 | code["low"][i, k]
    return high


def successor(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place in [begin, end) whose id is not below ``wanted``, for each query; ids rise within each range. A query that is settled takes no further step."""
    found = begin.copy()
    open_ = np.flatnonzero(begin < end)
    a, b, wanted = begin[open_], end[open_], wanted[open_]
    while len(open_):
        mid = (a + b) >> 1
        below = ids[mid] < wanted
        a, b = np.where(below, mid + 1, a), np.where(below, b, mid)
        found[open_] = a
        still = np.flatnonzero(a < b)
        open_, a, b, wanted = open_[still], a[still], b[still], wanted[still]
    return found
