"""What the corpus operators share: reading, shared tables, and Arrow batches inside tasks.

Every operator takes a DataFrame with at least ``doc_id`` and ``text``; other columns are ignored
(or carried, where the docstring says so). A null text counts as the empty text everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.shared import new_path, shared_dir, stored  # noqa: F401  used by the operators

#: Text bytes handled at once inside a task; a longer single text stands alone.
BATCH_BYTES = 2_000_000
#: Rows handled at once at most.
ROWS_AT_ONCE = 4096


#: Arrow's own pool keeps what a task frees; the system's gives it back, as workers live from stage to stage.
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Freed memory goes back to the system, where the C library knows how to (glibc)."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Bytes of an Arrow batch between Spark and its Python workers (a longer single row stands alone): both sides hold several batches at once beside the heap.
ARROW_BATCH = "8m"


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches are bounded by ARROW_BATCH from now on."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return docs


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named, so that scans read nothing else."""
    small_batches(docs)
    return docs.select("doc_id", *more, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id gives -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``most`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
        block = np.maximum(np.cumsum(sizes, dtype=np.int64) // most, np.arange(batch.num_rows) // ROWS_AT_ONCE)
        edges = np.flatnonzero(np.diff(block)) + 1  # both parts of block only rise
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def flat(texts: list[bytes], pad: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each with ``pad`` before and one after the last; where each begins (and the end)."""
    joined = pad + pad.join(texts) + pad
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(pad) for t in texts], out=starts[1:])
    return np.frombuffer(joined, np.uint8), starts


def cut_words(texts: list[bytes], apart: np.ndarray, as_: np.ndarray, cut: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts as a dictionary array, where each begins in the texts joined by line ends, the text that each is of, and the joined bytes.

    ``apart``: whether a byte stands between words; ``as_``: what a byte of a word is taken for; ``cut(bytes)``: where a word begins although no byte stands between.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    inside = ~apart[data]
    inside[-1] = False  # the last line end
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if cut is not None:
        begins |= inside & cut(data)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    edges = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=edges[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(as_[data[inside]])])
    return words.dictionary_encode(), starts, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))), data


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i+1]] for each i (0 where empty)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a uint64 array)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordTable(dict):
    """word (bytes) -> row number; what is known of a word is computed once, for many words at a time.

    ``describe(words)`` gives one array for each property. The table is emptied between batches once
    it has ``limit`` words, so its memory is bounded whatever the vocabulary.
    """

    def __init__(self, describe: Callable[[list[bytes]], tuple[np.ndarray, ...]], limit: int = 400_000):
        super().__init__()
        self.describe, self.limit, self.fresh, self.rows = describe, limit, [], ()

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def find(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of ``words``; what is known of row i stands at i of each array in ``rows``."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh or not self.rows:
            new = self.describe(self.fresh)
            self.rows = tuple(np.concatenate([a, b]) for a, b in zip(self.rows, new, strict=True)) if self.rows else new
            self.fresh = []
        return at

    def trim(self) -> bool:
        """Empties a table that has become too large; row numbers begin anew."""
        if len(self) <= self.limit:
            return False
        self.clear()
        self.fresh, self.rows = [], ()
        return True

    def look(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each property, its values for ``words``, in order."""
        self.trim()
        at = self.find(words)
        return tuple(r[at] for r in self.rows)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray]:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; order matters. Empty where there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow(schema: str) -> pa.Schema:
    """'a long, b array<int>' -> the Arrow schema that mapInArrow returns rows in."""
    fields = [f.split() for f in schema.split(",")]
    return pa.schema([(name, pa.list_(KINDS[kind[6:-1]]) if kind.startswith("array<") else KINDS[kind]) for name, kind in fields])


def out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
