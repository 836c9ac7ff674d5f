"""Token ids in binary files: each document a zstandard frame of its own, all with one shared dictionary.

A dictionary is trained on the serialised id arrays of short documents, since long ones need none. Every document is
compressed alone with it, so one document is read without its neighbours. A file is

    head    magic, version, bytes an id, digest of the dictionary, number of documents
    index   for each document: its id (and whether it has one), number of ids, end of its frame
    frames  one after the other, in ascending order of doc_id

Files are binary values of a Parquet table, a row a file, so Spark commits them and any store that Spark reaches will do;
the row also tells the range it is of, the ids before it in that range, and the least and greatest doc_id, by which scans skip files.
What all ranges before a range hold is a sum over one row for each range, so ``start`` needs no task that sees all documents.

A null text is empty and gives the end id alone. Documents without doc_id come last. Repeated rows and ids each keep a place;
rows of one id lie by number of ids, then by crc32 of the ids. An empty table gives no files and no rows. Other columns are ignored.
A file that was written with another dictionary, or is cut short or changed, raises ValueError or ZstdError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.common import arrow, cut_words, id_and_text, out, pieces, raw, table
from trailmill.operators.ordering import offsets
from trailmill.shared import new_path

#: Bound of the dictionary's sample: so many documents of so many characters at most.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SPARE = 2000, 4096, 16
DICTIONARY_BYTES, LEVEL = 65536, 3
#: A file ends after so many bytes of frames, or documents; a longer single document has its own.
FILE_BYTES, FILE_DOCS = 4_000_000, 16_384
#: Bytes of frames that one task writes; a row is a row group, so a task holds one file in memory and any number of tasks may read what it wrote.
WRITTEN_BYTES = 64_000_000
#: Documents whose digests one task gives out.
GIVEN_DOCS = 1_000_000
#: Text bytes encoded at once.
BLOCK_BYTES = 8_000_000
MAGIC, HEAD = b"TMZ1", "<4sHH8sI"
END = 2

#: Words remembered by a worker, in each of two generations; words that go through the library in one text.
REMEMBERED, TOGETHER = 400_000, 500
#: White space, which no token holds; letters, and marks before which a word may be cut, since no token holds a letter and one of them; A-Z as a-z, which the vocabulary does itself.
SPACE = np.isin(np.arange(256), [*b" \t\n\x0b\x0c\r"])
LETTER, MARK = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]), np.isin(np.arange(256), [*b".,;:!?"])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) < 91), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: A word of its own that parts words in one text; texts that hold it, or what a special token begins with, are given to the library whole.
APART, SPECIAL = "\x01", b"<|"


def _cut(data: np.ndarray) -> np.ndarray:
    at = np.zeros(len(data), bool)
    at[1:] = MARK[data[1:]] & LETTER[data[:-1]]
    return at


class Encoder:
    """Ids of whole texts by the tokenizers library.

    By the vocabulary's rule no token holds white space, or a letter and a mark after it, and A-Z are a-z; so a text's ids are those of its words. Each word goes
    through the library once, many in one text, and is remembered as packed ids; memory is bounded by ``REMEMBERED`` words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.width = 2 if self.own.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        (self.apart,) = self.ids([APART])[0].tolist()

    def pack(self, ids) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        """Remembers the packed ids of each word."""
        for a in range(0, len(words), TOGETHER):
            some = words[a : a + TOGETHER]
            (got,) = self.ids([f" {APART} ".join([w.decode() for w in some])])
            ends = np.flatnonzero(got == self.apart)
            starts, data = np.append(0, ends + 1) * self.width, got.tobytes()
            self.known.update((w, data[i:j]) for w, i, j in zip(some, starts.tolist(), [*(ends * self.width).tolist(), len(data)], strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text, without end id."""
        whole = [i for i, t in enumerate(texts) if SPECIAL in t or APART.encode() in t]
        odd = dict(zip(whole, self.ids([texts[i].decode() for i in whole]), strict=True)) if whole else {}
        words, _, text, _ = cut_words([b"" if i in odd else t for i, t in enumerate(texts)], SPACE, LOWER, _cut)
        kinds = words.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        fresh = [w for w in kinds if w not in self.known]
        self.known.update((w, self.older[w]) for w in fresh if w in self.older)
        self.learn([w for w in fresh if w not in self.older])
        packed = pa.array([self.known[w] for w in kinds], pa.binary()).take(words.indices)
        ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset) if len(packed) else np.zeros(1, np.int32)
        data, edges = packed.buffers()[2].to_pybytes() if len(packed) else b"", ends[np.searchsorted(text, np.arange(len(texts) + 1))]
        return [odd[i].tobytes() if i in odd else data[a:b] for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
    return Encoder(path)


def digest(dictionary: bytes) -> bytes:
    return hashlib.blake2b(dictionary, digest_size=8).digest()


def codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True), zstandard.ZstdDecompressor(dict_data=shared)


def train_dictionary(docs: DataFrame, path: str, end: int = END) -> bytes:
    """Bytes of the shared dictionary, from at most SAMPLE_DOCS short documents; empty where there are too few to train on.

    The sample is taken by a hash of id and text, so it is spread over the table: rows below a hash that SAMPLE_SPARE times the sample should lie below,
    however many there are, and of them the least; one task trains on it.
    """
    share = min(1.0, SAMPLE_SPARE * SAMPLE_DOCS / max(docs.count(), 1))
    short = id_and_text(docs).where(F.length("text").between(1, SAMPLE_CHARS) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))))
    sample = short.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(SAMPLE_DOCS).select("text")

    def run(batches):
        own, ids = encoder(path), []
        for b in batches:
            ids += [x + own.pack([end]) for x in own.encode(raw(b))]
        trained = b""
        if ids:
            try:
                trained = zstandard.train_dictionary(DICTIONARY_BYTES, ids, k=256, d=8).as_bytes()
            except zstandard.ZstdError:  # too few or too short: the library gives no dictionary then
                trained = b""
        yield out(arrow("dictionary binary"), [trained])

    return next(iter(sorted((bytes(r["dictionary"]) for r in sample.coalesce(1).mapInArrow(run, "dictionary binary").collect()), key=len, reverse=True)), b"")


def frames(docs: DataFrame, path: str, dictionary: bytes, end: int = END) -> DataFrame:
    """doc_id, n_ids, crc, frame: each text's ids with the end id, compressed alone. crc is of the ids as unsigned 32-bit integers."""
    schema = "doc_id long, n_ids long, crc long, frame binary"

    def run(batches):
        own, to = encoder(path), arrow(schema)
        pressed, _ = codec(dictionary)
        for b in pieces(batches, most=BLOCK_BYTES):
            ids = [x + own.pack([end]) for x in own.encode(raw(b))]
            yield out(to, b.column("doc_id").cast(pa.int64()), [len(x) // own.width for x in ids], [crc_of(x, own.width) for x in ids], [pressed.compress(x) for x in ids])

    return id_and_text(docs).mapInArrow(run, schema)


def crc_of(packed: bytes, width: int) -> int:
    return zlib.crc32(packed if width == 4 else np.frombuffer(packed, "<u2").astype("<u4"))


def bind(ids: list[int | None], counts: list[int], parts: list[bytes], width: int, key: bytes) -> bytes:
    """One file."""
    n = len(ids)
    index = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
    index += np.array(counts, "<u4").tobytes() + np.cumsum([len(p) for p in parts], dtype="<i8").tobytes()
    return struct.pack(HEAD, MAGIC, 1, width, key, n) + index + b"".join(parts)


class File:
    """One file, opened: ids, counts, and the ids of document i by ``packed(i)``."""

    def __init__(self, stored: bytes, dictionary: bytes):
        head = struct.calcsize(HEAD)
        if len(stored) < head:
            raise ValueError("a token file is cut short")
        magic, version, self.width, key, n = struct.unpack_from(HEAD, stored)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        if key != digest(dictionary):
            raise ValueError("the token file was written with another dictionary")
        self.body = head + n * (8 + 1 + 4 + 8)
        if len(stored) < self.body:
            raise ValueError("a token file is cut short")
        at = [head, head + 8 * n, head + 9 * n, head + 13 * n]
        ids, none = np.frombuffer(stored, "<i8", n, at[0]), np.frombuffer(stored, np.uint8, n, at[1])
        self.counts, self.ends = np.frombuffer(stored, "<u4", n, at[2]), np.frombuffer(stored, "<i8", n, at[3])
        self.ids = [None if z else int(i) for i, z in zip(ids, none, strict=True)]
        if n and len(stored) != self.body + self.ends[-1]:
            raise ValueError("a token file is cut short")
        self.stored, self.opened = stored, codec(dictionary)[1]

    def packed(self, i: int) -> bytes:
        a = self.body + (int(self.ends[i - 1]) if i else 0)
        got = self.opened.decompress(self.stored[a : self.body + int(self.ends[i])])
        if len(got) != self.width * int(self.counts[i]):
            raise ValueError("a document's ids are not as many as its file's index says")
        return got

    def array(self, i: int) -> np.ndarray:
        return np.frombuffer(self.packed(i), f"<u{self.width}")


FILES = "part int, seq int, start_in_part long, n_docs long, n_ids long, first_id long, last_id long, file binary"


def write(docs: DataFrame, path: str, end: int = END) -> str:
    """Encodes and writes ``docs``; gives the new folder, with ``dictionary`` (one row) and ``files``.

    Frames are kept on the executors' disks before they are ranged: finding the ranges reads them once more, and only then no text is encoded twice.
    Few tasks write the files, each all of several ranges: ``WRITTEN_BYTES`` of frames a task, and at least as many tasks as there are cores.
    """
    spark = docs.sparkSession
    dictionary, to = train_dictionary(docs, path, end), new_path(spark, "tokens")
    kept = frames(docs, path, dictionary, end).persist(StorageLevel.DISK_ONLY)
    try:
        _write(kept, dictionary, encoder(path).width, to)
    finally:
        kept.unpersist()
    return to


def _write(kept: DataFrame, dictionary: bytes, width: int, to: str) -> None:
    spark = kept.sparkSession
    size = kept.agg(F.coalesce(F.sum(F.length("frame")), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // WRITTEN_BYTES))
    rows = kept.withColumn("tie", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = digest(dictionary)
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_ids"), F.col("crc"), F.col("tie")]
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "n_ids", "frame")

    def run(batches):
        schema, held, size, part, seq, start = arrow(FILES), [], 0, 0, 0, 0

        def file():
            ids, counts, parts = zip(*held, strict=True)
            given = [i for i in ids if i is not None]
            return out(schema, [part], [seq], [start], [len(ids)], [sum(counts)], [given[0] if given else None], [given[-1] if given else None], [bind(ids, counts, parts, width, key)])

        for b in batches:
            for p, i, c, f in zip(*(b.column(k) for k in range(4)), strict=True):
                if held and (size + len(f.as_buffer()) > FILE_BYTES or len(held) >= FILE_DOCS):
                    yield file()
                    start, seq, held, size = start + sum(c for _, c, _ in held), seq + 1, [], 0
                part = p.as_py()
                held.append((i.as_py(), c.as_py(), f.as_py()))
                size += len(held[-1][2])
        if held:
            yield file()

    spark.createDataFrame([(key, dictionary)], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{to}/dictionary")
    sorted_rows.mapInArrow(run, FILES).coalesce(tasks).write.option("parquet.block.row.count.limit", 1).parquet(f"{to}/files")


def opened(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    return spark.read.schema(FILES).parquet(f"{folder}/files"), bytes(row["dictionary"])


def with_starts(files: DataFrame) -> DataFrame:
    """The files with ``start``: ids of all documents before the file."""
    before = offsets(files, "part", F.sum("n_ids"))
    return files.join(F.broadcast(before), "part").select((F.col("before") + F.col("start_in_part")).alias("start"), "file")


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_ids, ids of all documents, or of those named: only files that may hold them are read, and only their frames are opened."""
    files, dictionary = opened(spark, folder)
    wanted = set(doc_ids) if doc_ids is not None else None
    every = with_starts(files)
    if wanted is not None:  # the offsets are sums over all files, of one narrow column
        near = F.lit(False)
        for i in sorted(wanted):
            near |= F.lit(i).between(F.col("first_id"), F.col("last_id"))
        some = files.where(near)
        every = some.join(F.broadcast(offsets(files, "part", F.sum("n_ids"))), "part").select((F.col("before") + F.col("start_in_part")).alias("start"), "file")
    schema = "doc_id long, start long, n_ids long, ids array<int>"

    def run(batches):
        to = arrow(schema)
        for b in batches:
            for start, file in zip(b.column("start"), b.column("file"), strict=True):
                f = File(file.as_py(), dictionary)
                starts = start.as_py() + np.concatenate([[0], np.cumsum(f.counts, dtype=np.int64)])
                at = [i for i, d in enumerate(f.ids) if wanted is None or d in wanted]
                for some in (at[k : k + 512] for k in range(0, len(at), 512)):
                    yield out(to, [f.ids[i] for i in some], [int(starts[i]) for i in some], [int(f.counts[i]) for i in some], [f.array(i).astype(np.int32) for i in some])

    return every.mapInArrow(run, schema)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; the ids stay in their task."""
    files, dictionary = opened(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        to = arrow(schema)
        for b in batches:
            for start, file in zip(b.column("start"), b.column("file"), strict=True):
                f = File(file.as_py(), dictionary)
                starts = start.as_py() + np.concatenate([[0], np.cumsum(f.counts, dtype=np.int64)])[:-1]
                yield out(to, f.ids, starts, f.counts.astype(np.int64), [crc_of(f.packed(i), f.width) for i in range(len(f.ids))])

    tasks = max(spark.sparkContext.defaultParallelism, -(-files.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0] // GIVEN_DOCS))
    return with_starts(files).mapInArrow(run, schema).repartition(tasks)  # four numbers a document, which few tasks may write


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op11_tokenfile(spark, sf_dir: str) -> DataFrame:
    return digests(spark, write(table(spark, sf_dir, "documents"), public_vocabulary()))
