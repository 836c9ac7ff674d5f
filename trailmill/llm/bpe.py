"""Byte-level BPE in two tiers, by the ranks of a public vocabulary file (its path is a parameter).

Tier one: a minimal perfect hash over the vocabulary (hash and displace: every token has its own slot,
no slot is free) resolves a whole pre-token that is itself a token. Tier two: other pre-tokens are
merged by rank with a heap over linked bytes, n log n in the length of the pre-token. Results of
both are remembered per worker in two generations of bounded size.

Null text: empty, no ids. Special tokens are never used. Any Unicode text round-trips.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from trailmill.llm.common import arrow, give_back, id_and_text, out, pieces, table

#: Pre-tokens remembered in each of the two generations of a worker's memory.
REMEMBERED = 250_000
#: Longer pre-tokens are worked out each time.
LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def place(x: int, y: int, d: int, n: int) -> int:
    """Slot of a key with hash halves x, y under displacement d."""
    return (((x + d * y) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) % n


class PerfectHash:
    """Minimal perfect hash of n byte strings to 0..n-1: buckets by one hash, largest first, each with
    the first displacement that sends all its keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = array("q", bytes(8 * self.buckets))
        members: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            members.setdefault((h >> 96) % self.buckets, []).append((h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF, i))
        self.slot = array("q", [-1]) * n
        free = bytearray(b"\1") * n
        for b, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) > 1:
                d, f0, f1 = 0, [x[0] for x in own], [x[1] for x in own]
                while True:
                    at = {place(x, y, d, n) for x, y in zip(f0, f1, strict=True)}
                    if len(at) == len(own) and all(free[a] for a in at):
                        break
                    d += 1
                self.shift[b] = d
                for x, y, i in own:
                    free[a := place(x, y, d, n)] = 0
                    self.slot[a] = i
        rest = (a for a in range(n) if free[a])
        for b, own in members.items():  # a bucket of one key names its slot
            if len(own) == 1:
                a = next(rest)
                self.shift[b] = -1 - a
                self.slot[a] = own[0][2]

    def __call__(self, key: bytes) -> int:
        """Index of the only key that ``key`` can be."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 96) % self.buckets]
        return self.slot[-1 - d if d < 0 else place(h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF, d, self.n)]


class Codec:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = list(self.ranks)
        self.ids = [self.ranks[t] for t in self.tokens]
        self.whole = PerfectHash(self.tokens)
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(self.ids) + 1)
        for t, r in self.ranks.items():
            self.bytes_of[r] = t
        self.forget()

    def forget(self) -> None:
        """Empties the memory of pre-tokens."""
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Merge by lowest rank, leftmost first: a heap of pairs over a linked list of byte runs."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # where the run that starts here ends
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of its two runs has been merged since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def work_out(self, piece: str) -> bytes:
        word = piece.encode()
        k = self.whole(word)
        return array("I", [self.ids[k]] if self.tokens[k] == word else self.merge(word)).tobytes()

    def __getitem__(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        if (got := self.new.get(piece)) is None:
            if (got := self.old.get(piece)) is None:
                got = self.work_out(piece)
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.new) >= REMEMBERED:
                    self.old, self.new = self.new, {}
                self.new[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        found, new = self.find(text), self.new
        try:
            return b"".join([new[p] for p in found])  # all known: the usual case for short texts
        except KeyError:
            return b"".join(map(self.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process; its memory lasts from task to task."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each text. What a task has remembered goes with it, so that the stages that follow in the same worker have its memory."""

    def run(batches):
        c, to = codec(path, pattern), arrow("doc_id long, ids array<int>")
        for b in pieces(batches):
            packed = [c.encode(t) for t in b.column("text").to_pylist()]
            ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            yield out(to, b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), ids).cast(to.field(1).type))
        c.forget()
        give_back()

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of each list of ids (null ids: empty)."""

    def run(batches):
        c, to = codec(path, pattern), arrow("doc_id long, text string")
        for b in batches:
            yield out(to, b.column("doc_id"), [c.decode(np.asarray(x or [], "<u4").tobytes()).decode() for x in b.column("ids").to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes each text and decodes its ids, in one pass; digests of both."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        c, to = codec(path, pattern), arrow(schema)
        for b in pieces(batches):
            ids = [c.encode(t) for t in b.column("text").to_pylist()]
            yield out(to, b.column("doc_id"), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(c.decode(x)).hexdigest() for x in ids])

    return id_and_text(docs).mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *public_vocabulary())
