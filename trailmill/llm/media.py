"""Content-defined chunking of payload columns.

A text's payload is its UTF-8 bytes, padded with spaces to a positive multiple of 192 and taken as
8-bit samples. A rolling gear hash over the samples cuts the payload where its low bits are zero, so equal
passages give equal chunks wherever they stand. Chunks are stored once for each digest; each distinct
payload keeps an ordered chunk list, by which the payload is put together again and verified.

    chunk store   digest, packed bytes         (one row for each distinct chunk)
    chunk lists   payload digest, ordered digests

Putting together raises an error where a chunk is lost or differs; it never gives a shorter payload. Null text: empty, one frame of 192 spaces. Equal texts give equal payloads, lists, and media. Repeated
rows and repeated doc_ids each give a row.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import arrow, id_and_text, mix, out, pieces, raw, table

FRAME = 192
#: Fixed values of the cutter: a hash window of 32 samples, chunks of 8 KiB on average, of 2 to 64 KiB.
WINDOW, MASK, LEAST, MOST = 32, (1 << 13) - 1, 2048, 65536
GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. Position i is a candidate if the gear hash of samples up to i has low bits of zero.

    In the usual rolling form the hash is doubled at each sample, so a sample leaves a 32-bit hash after 32
    steps; here the same sum is built by doubling spans: 1, 2, 4, ... 32 samples.
    """
    n = len(data)
    if n <= LEAST:
        return [n]
    h, span = GEAR[np.frombuffer(data, np.uint8)], 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    ends, at = [], 0
    for c in (np.flatnonzero((h >> np.uint32(19)) == 0) + 1).tolist():
        while c - at > MOST:
            ends.append(at := at + MOST)
        if c - at >= LEAST and c < n:
            ends.append(at := c)
    while n - at > MOST:
        ends.append(at := at + MOST)
    return [*ends, n]


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, samples) in order."""
    ends = cuts(data)
    return [(hashlib.blake2b(c, digest_size=16).digest(), c) for a, b in zip([0, *ends], ends) for c in (data[a:b],)]


def media(parts: list[tuple[bytes, bytes]]) -> bytes:
    """The stored form of one payload: a header, the ordered chunk list, and each distinct chunk once."""
    first: dict[bytes, int] = {}
    for d, _ in parts:
        first.setdefault(d, len(first))
    body = dict(parts)
    head = struct.pack("<4sHHII", b"CDC1", 8, FRAME, len(parts), len(first))
    return head + b"".join(struct.pack("<II", first[d], len(c)) for d, c in parts) + b"".join(body[d] for d in first)


def unpack(stored: bytes) -> bytes:
    """The payload in a stored form."""
    magic, _, _, n, _ = struct.unpack_from("<4sHHII", stored)
    if magic != b"CDC1":
        raise ValueError("not a chunked payload")
    listed = [struct.unpack_from("<II", stored, 16 + 8 * i) for i in range(n)]
    at, where = 16 + 8 * n, {}
    for k, size in listed:
        if k not in where:
            where[k] = stored[at : at + size]
            at += size
    return b"".join(where[k] for k, _ in listed)


def feature(data: bytes) -> str:
    """Mean level, peak and zero crossings about the middle of the samples."""
    s = np.frombuffer(data, np.uint8)
    return f"u8:{int(s.sum(dtype=np.int64)) // len(s)}:{int(s.max())}:{int(np.count_nonzero(np.diff(s > 96)))}"


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, key (digest of the ordered list), digests (the list); no samples."""
    schema = "doc_id long, n_bytes long, key binary, digests array<binary>"

    def run(batches):
        to = arrow(schema)
        for b in pieces(batches):
            texts = raw(b)
            listed = [[d for d, _ in chunks(payload(t))] for t in texts]
            yield out(to, b.column("doc_id"), [len(t) for t in texts], [hashlib.blake2b(b"".join(x), digest_size=16).digest() for x in listed], listed)

    return id_and_text(docs).mapInArrow(run, schema)


def chunk_store(docs: DataFrame) -> DataFrame:
    """digest, packed: each distinct chunk once. A task sends a digest once; the group by digest ends the copies between tasks."""
    schema = "digest binary, packed binary"

    def run(batches):
        to, sent = arrow(schema), set()
        for b in pieces(batches):
            found = {}
            for t in raw(b):
                found.update(chunks(payload(t)))
            fresh = [(d, c) for d, c in found.items() if d not in sent]
            if len(sent) > 1_000_000:  # bounded memory: copies beyond it fall to the group by digest
                sent.clear()
            sent.update(d for d, _ in fresh)
            yield out(to, [d for d, _ in fresh], [bz2.compress(c) for _, c in fresh])

    return id_and_text(docs).mapInArrow(run, schema).groupBy("digest").agg(F.first("packed").alias("packed"))


#: Payload bytes after which results are handed on.
AT_ONCE = 8_000_000


def rebuild(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Each distinct payload put together from the store, and read back from its stored form.

    Raises ValueError where a chunk is missing, doesn't match its digest, or the ordered list doesn't match ``key``. Spark
    hands payloads over in Arrow batches bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch); one is unpacked at a time.
    """
    schema = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    wanted = lists.groupBy("key").agg(F.first("digests").alias("digests")).select("key", F.posexplode("digests").alias("at", "digest"))
    parts = wanted.join(store, "digest", "left").groupBy("key").agg(F.collect_list(F.struct("at", "digest", "packed")).alias("parts"))

    def one(key: bytes, parts: list[dict]) -> tuple:
        listed = sorted(parts, key=lambda p: p["at"])
        if any(p["packed"] is None for p in listed):
            raise ValueError("a chunk of a payload is missing from the store")
        got = [(p["digest"], bz2.decompress(p["packed"])) for p in listed]
        if any(hashlib.blake2b(c, digest_size=16).digest() != d for d, c in got):
            raise ValueError("a stored chunk does not match its digest")
        if hashlib.blake2b(b"".join(d for d, _ in got), digest_size=16).digest() != key:
            raise ValueError("a chunk list does not match its payload's key")
        form = media(got)
        data = unpack(form)
        return key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(form), hashlib.sha256(form).hexdigest(), feature(data), len(got)

    def run(batches):
        to, made, size = arrow(schema), [], 0
        for b in batches:
            for key, parts in zip(b.column("key"), b.column("parts"), strict=True):
                made.append(one(key.as_py(), parts.as_py()))
                size += made[-1][1]
                if size > AT_ONCE:
                    yield out(to, *zip(*made))
                    made, size = [], 0
        if made:
            yield out(to, *zip(*made))

    return parts.mapInArrow(run, schema)


def op4_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lists = chunk_lists(docs)
    return lists.drop("digests").join(rebuild(lists, chunk_store(docs)), "key").drop("key")
