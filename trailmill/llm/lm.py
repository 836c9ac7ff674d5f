"""Language-model scores from a sharded n-gram trie.

Tokens are lower-cased (A-Z) runs of non-blanks, then one end. Level 1 of the trie has words, level 2 the words' contexts
of one token, level 3 of two. Contexts of these levels are classes: one of the ``HEAD`` most frequent words, any other
word, or the beginning; one token further back only the five most frequent words have classes of their own. So
their counts are arrays of fixed size that every task can hold. Below them level 4 has the whole contexts, whatever the words: of two tokens, and of
one where it is no frequent word (of a frequent word level 2 has it). Words, n-grams and shards grow with the corpus.

    P1(w) = (1 - u) c(w) / N, and u for an unknown word (one type, as in the base); u: the share of words seen once
    P2(w | a) = (c(a w) + M2 P1(w)) / (c(a) + M2);  P3(w | a b) = (c(a b w) + M3 P2(w | b)) / (c(a b) + M3), by classes
    P(w | a b) = (TWO c(b a w) + ONE c(a w) + M4 P3(w | a b)) / (TWO c(b a) + ONE c(a) + M4), by the words themselves, ONE being 0 where a is frequent;
    the first token of a text, which has no word before it, keeps its P3

Counting: tasks send packed n-gram counts to shards (by word; of frequent words, by word and context, so no
shard has all of a hot word). Their sums are stored, and the contexts' numbers are sums over them. Each shard is built into compact levels: Elias-Fano pointers, context ids relative to
their parent, and log probabilities quantised to 256 levels; whole contexts have their counts. Scoring: tasks send packed n-grams of their texts to the shards;
a shard builds its levels, finds words, then contexts by successor search between two pointers, and
sends one partial sum for each text. A whole context's own count is that of its nearer word after the other, so the shard of that word takes the logarithm of what
P divides by, and no count of a context is sent anywhere. Shards number one for each ``PER_SHARD`` training tokens, whatever the size.

Null text: empty, i.e. one end token. Repeated rows and repeated doc_ids each get a row. An empty table gives no rows; without training rows all words are unknown. Words are 64-bit hashes inside, rare words of a context 40 bits of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm import eliasfano
from trailmill.llm.common import ROWS_AT_ONCE, WordTable, arrow, crc_mod, give_back, id_and_text, mix, out, pieces, raw, stored, table

HEAD, FAR = (1 << 15) - 2, 5
RARE, BEGIN = 0, (1 << 15) - 1  # context codes; the head has 1..HEAD
END = b"\xff"  # no byte of any UTF-8 text
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))
M2, M3 = 300.0, 300.0
TWO, ONE, M4 = 4.0, 1.0, 100.0
RARE_BITS = np.uint64((1 << 40) - 1)
PER_SHARD = 3_000_000
#: Text bytes whose n-grams are sent together, about.
BLOCK_BYTES = 4_000_000
ROUNDS = 2


def pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(struct.pack("<BQ", "BHIQilqd".index(np.dtype(a.dtype).char if a.dtype.char != "L" else "Q"), len(a)) + a.tobytes() for a in map(np.ascontiguousarray, arrays))
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    body, at, got = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(body):
        kind, n = struct.unpack_from("<BQ", body, at)
        a = np.frombuffer(body, np.dtype("BHIQilqd"[kind]), n, at + 9)
        got.append(a)
        at += 9 + a.nbytes
    return got


def blocks(batches) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about BLOCK_BYTES of text: small ones are put together, so that a shard's share of a block is not small either."""
    held, size = [], 0
    for b in pieces(batches, most=BLOCK_BYTES):
        if held and (size + b.nbytes > BLOCK_BYTES or sum(h.num_rows for h in held) + b.num_rows > ROWS_AT_ONCE):
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def words_of(texts: list[bytes]) -> list[bytes]:
    """The tokens of all texts, each text followed by END."""
    return b" \xff ".join([*texts, b""]).lower().split()


def hashes(words: list[bytes]) -> tuple[np.ndarray]:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),)


def count_words(docs: DataFrame) -> DataFrame:
    """h, c: every token's hash and count, the end included. A task sends a word once for each filling of its table."""

    def run(batches):
        to, words, n = arrow("h long, n long"), WordTable(hashes), np.zeros(0, np.int64)
        for b in pieces(batches):
            at = words.find(words_of(raw(b)))
            n = np.pad(n, (0, len(words) - len(n))) + np.bincount(at, minlength=len(words))
            h = words.rows[0]
            if words.trim():
                yield out(to, h.view(np.int64), n)
                n = np.zeros(0, np.int64)
        if len(n):
            yield out(to, words.rows[0].view(np.int64), n)

    return id_and_text(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


class Head:
    """What every task holds: the frequent words, the totals, and the context weights; of fixed size."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, once: int, ends: int = 0):
        order = np.argsort(hashes)
        self.hashes, self.code = hashes[order], (order + 1).astype(np.int64)
        self.count = np.zeros(HEAD + 2, np.int64)
        self.count[1 : len(counts) + 1] = counts
        self.count[BEGIN] = ends
        self.word = np.full(HEAD + 2, END_HASH)  # by place
        self.word[self.code] = self.hashes
        self.total, self.distinct = total, distinct
        self.unknown = min(max(once, 1) / max(total, 1), 0.5) if total else 1.0
        self.shards = max(4, -(-total // PER_SHARD))
        self.contexts, self.after_rare = (np.zeros((HEAD + 2, 8), np.int64) for _ in range(2))

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.code[at], RARE)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The codes; the end, which is as frequent as texts are, has that of the beginning, which is no word."""
        return np.where(h == END_HASH, BEGIN, self.codes(h))

    def describe(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        return h, self.codes(h)

    def first(self, c: np.ndarray) -> np.ndarray:
        """P1 by count."""
        return np.where(c > 0, (1 - self.unknown) * c / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))


def grams(texts: list[bytes], words: WordTable) -> tuple[np.ndarray, ...]:
    """For all tokens: row in the word table, context code, class of the context before it, and the text's number."""
    words.trim()
    at = words.find(words_of(texts))
    code = words.rows[1][at]
    ends = np.flatnonzero(at == words[END])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[-1], ends])))
    starts = np.concatenate([[0], ends[:-1] + 1])
    near = np.concatenate([[BEGIN], code[:-1]])
    near[starts] = BEGIN
    far = np.concatenate([[BEGIN], near[:-1]])
    far[starts] = BEGIN
    far = np.where(far == BEGIN, FAR + 2, np.minimum(far, FAR + 1))
    return at, near, far, doc


class Grams:
    """The whole contexts of all tokens beside ``grams``: at, near, far, doc; ``code``: the code of the word further back; ``a`` and ``b``: 40 bits of the nearer and the further word's hash, 0 where a code says it."""

    def __init__(self, texts: list[bytes], words: WordTable):
        self.at, self.near, self.far, self.doc = grams(texts, words)
        h = words.rows[0][self.at] & RARE_BITS
        self.code = np.where(self.near == BEGIN, BEGIN, np.concatenate([[BEGIN], self.near[:-1]]))
        self.a = np.where(self.near == RARE, np.concatenate([h[:1], h[:-1]]), np.uint64(0))
        self.b = np.where(self.code == RARE, np.concatenate([h[:1], h[:1], h[:-2]])[: len(h)], np.uint64(0))


def dealt(g: Grams, words: WordTable, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each shard that is asked: its number, and the places of its n-grams, sorted by word (frequent ones first, by place), then by nearer and further code.

    A word has one shard. A frequent word has one for each frequent word before it, and rare words before it are dealt by themselves.
    """
    place = np.where(words.rows[0] == END_HASH, BEGIN, words.rows[1])
    rank = np.where(place > 0, place, BEGIN + 1 + np.arange(len(place)))
    order = np.argsort(rank[g.at] << 30 | g.near << 15 | g.code)
    row, near, a = g.at[order], g.near[order], g.a[order]
    pair = (place[row] << 16 | near).view(np.uint64)
    shard = (mix(np.where(place[row] == 0, words.rows[0][row], np.where(near == RARE, pair ^ a << np.uint64(24), pair))) % np.uint64(shards)).astype(np.uint16 if shards < 65536 else np.uint32)
    deal = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[deal], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        yield s, order[deal[edges[s] : edges[s + 1]]]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    at = np.flatnonzero(np.concatenate([[len(values) > 0], values[1:] != values[:-1]]))
    return at, np.diff(np.concatenate([at, [len(values)]]))


def packed(head: Head, words: np.ndarray, per: np.ndarray, near: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> bytes:
    """N-grams by word: the words' hashes (places of frequent ones), how many n-grams each has, and their contexts; ``more`` goes with the n-grams."""
    place = head.places(words)
    a, b = a[near == RARE], b[code == RARE]
    halves = [x for h in (a, b) for x in ((h >> np.uint64(32)).astype(np.uint8), h.astype(np.uint32))]
    planes = [(x >> k).astype(np.uint8) for x in (place, near, code) for k in (8, 0)]
    return pack(words[place == 0], small(per), *planes, *halves, *more)


def unpacked(head: Head, blob: bytes) -> tuple[np.ndarray, ...]:
    """What ``packed`` was given."""
    rare, per, place1, place0, near1, near0, code1, code0, a1, a0, b1, b0, *more = unpack(blob)
    place, near, code = (high.astype(np.int32) << 8 | low for high, low in ((place1, place0), (near1, near0), (code1, code0)))
    words = head.word[place]
    words[place == 0] = rare
    a, b = (np.zeros(len(near), np.uint64) for _ in range(2))
    a[near == RARE] = a1.astype(np.uint64) << np.uint64(32) | a0
    b[code == RARE] = b1.astype(np.uint64) << np.uint64(32) | b0
    return words, per, near, code, a, b, *more


def far_of(code: np.ndarray) -> np.ndarray:
    """The class of a code further back."""
    return np.where(code == BEGIN, FAR + 2, np.minimum(code, FAR + 1))


def context_ids(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each whole context after the nearer code: the further code, then 48 bits of what rare words it has."""
    h = np.zeros(len(code), np.uint64)
    some = np.flatnonzero(a | b)
    h[some] = mix(mix(a[some].copy()) ^ b[some]) >> np.uint64(16)
    return code.astype(np.int64) << 48 | h.view(np.int64)


def count_grams(docs: DataFrame, head) -> DataFrame:
    """shard, blob: packed n-gram counts, summed over a block of texts as far as they are neighbours."""

    def run(batches):
        own, to = head.value, arrow("shard int, blob binary")
        words = WordTable(own.describe)
        for batch in blocks(batches):
            g, shards, blobs = Grams(raw(batch), words), [], []
            for s, i in dealt(g, words, own.shards):
                row, near, code, a, b = g.at[i], g.near[i], g.code[i], g.a[i], g.b[i]
                same = (row[1:] == row[:-1]) & (near[1:] == near[:-1]) & (code[1:] == code[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                n = np.diff(np.concatenate([first, [len(row)]]))
                w, per = runs(row[first])
                shards.append(s)
                blobs.append(packed(own, words.rows[0][row[first][w]], per, near[first], code[first], a[first], b[first], small(n)))
            yield out(to, np.array(shards, np.int32), blobs)

    return id_and_text(docs).mapInArrow(run, "shard int, blob binary")


def small(n: np.ndarray) -> np.ndarray:
    most = n.max(initial=0)
    return n.astype(np.uint8 if most < 256 else np.uint32 if most < 1 << 32 else np.int64)


class Counts:
    """A shard's words, and its distinct n-grams with their numbers, sorted: ``pair`` (the word's place << 15 | near), ``id`` (``context_ids``), a, b, n."""

    def __init__(self, head: Head, parts: list[bytes], ordered: bool = False):
        got = [*map(list, zip(*(unpacked(head, p) for p in parts), strict=True))][::-1]
        self.head, (self.words, which) = head, np.unique(np.concatenate(got.pop()), return_inverse=True)
        self.pair = np.repeat(which, np.concatenate(got.pop())) << 15
        self.pair |= np.concatenate(got.pop())
        code, self.a, self.b, self.n = (np.concatenate(got.pop()) for _ in range(4))  # each frees its parts
        self.id, key = context_ids(code, self.a, self.b), self.pair << 15
        key |= code
        del code
        if not ordered:  # a stored part is
            order = np.argsort(key)
            key, ids = key[order], self.id[order]
            at, size = runs(key)
            mixed = np.flatnonzero(np.repeat(size > 1, size) & ((ids & (1 << 48) - 1) > 0))  # whole runs: only rare words tell their n-grams apart
            order[mixed] = order[mixed][np.lexsort((ids[mixed], key[mixed]))]
            del key, ids, mixed
            for name in ("pair", "id", "a", "b", "n"):  # one at a time
                setattr(self, name, getattr(self, name)[order])
            del order
        self.n = self.n.astype(np.int64)
        if len(self.n):
            first = np.flatnonzero(np.concatenate([[True], (self.pair[1:] != self.pair[:-1]) | (self.id[1:] != self.id[:-1])]))
            self.n = np.add.reduceat(self.n, first)
            for name in ("pair", "id", "a", "b"):
                setattr(self, name, getattr(self, name)[first])
        self.near, self.code = (self.pair & 0x7FFF).astype(np.int32), (self.id >> 48).astype(np.int32)

    def blob(self) -> bytes:
        w, per = runs(self.pair >> 15)
        return packed(self.head, self.words[self.pair[w] >> 15], per, self.near, self.code, self.a, self.b, small(self.n))

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells of ``Head.contexts`` (context << 3 | class of the one before), those of ``Head.after_rare`` behind them (word << 3 | class before the rare one), and what a shard's n-grams add to them.

        Each word but the end stands before one token more, with its own context as the one further back; a text has one end, and one token that begins it.
        """
        place = self.head.places(self.words)[self.pair >> 15]
        cell = np.where(place == BEGIN, BEGIN << 3 | FAR + 2, place << 3 | far_of(self.near))
        rare = (self.near == RARE) & (place > 0)
        cell = np.concatenate([cell, (HEAD + 2) * 8 + (place[rare] << 3 | far_of(self.code[rare]))])
        n = np.concatenate([self.n, self.n[rare]])
        order = np.argsort(cell, kind="stable")
        first, _ = runs(cell[order])
        return cell[order][first], np.add.reduceat(n[order], first)


def all_contexts(counted: DataFrame) -> np.ndarray:
    """How often each (context, class of the one before) stands before a token, and each frequent word behind a rare one, from all shards: two by HEAD + 2 by 8 numbers."""

    def run(batches):
        to = arrow("context int, n long")
        for b in batches:
            for blob in b.column("contexts"):
                cell, n = unpack(blob.as_py())
                yield out(to, cell.astype(np.int32), n)

    rows = counted.select("contexts").mapInArrow(run, "context int, n long").groupBy("context").agg(F.sum("n").alias("n")).toPandas()  # 2^19 rows at most
    n = np.zeros(2 * (HEAD + 2) * 8, np.int64)
    n[rows["context"].to_numpy(int)] = rows["n"].to_numpy(int)
    return n.reshape(2, -1, 8)


def quantised(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each value, and the mean of each byte's values: 256 bins of equal numbers."""
    if not len(logs):
        return np.zeros(0, np.uint8), np.zeros(256)
    cut = np.unique(np.quantile(logs, np.arange(1, 256) / 256))
    code = np.searchsorted(cut, logs, "right").astype(np.uint8)
    n = np.bincount(code, minlength=256)
    return code, np.bincount(code, logs, 256) / np.maximum(n, 1)


LEVELS = ("words", "counts", "low2", "high2", "seen2", "near", "p2", "book2", "low3", "high3", "seen3", "far", "p3", "book3", "n2", "low4", "high4", "seen4", "id4", "n4", "low1", "high1", "seen1", "id1", "n1")


def build(head: Head, blob: bytes) -> dict[str, np.ndarray]:
    """The levels of one shard, from its stored counts."""
    own = Counts(head, [blob], ordered=True)
    words = own.words
    at3, size4 = runs(own.pair << 3 | far_of(own.code))
    k, c3 = (own.pair << 3 | far_of(own.code))[at3], np.add.reduceat(own.n, at3)
    at2, size3 = runs(k >> 3)
    c2 = np.add.reduceat(c3, at2)
    at1, size2 = runs(k[at2] >> 18)
    place = head.places(words)
    counts = np.where(place > 0, head.count[place], np.add.reduceat(c2, at1))  # of a frequent word, other shards have the rest
    near2, far3 = k[at2] >> 3 & 0x7FFF, k & 7
    before2, before3 = head.contexts.sum(1)[near2], head.contexts[np.repeat(near2, size3), far3]
    p2 = (c2 + M2 * np.repeat(head.first(counts), size2)) / (before2 + M2)
    p3 = (c3 + M3 * np.repeat(p2, size3)) / (before3 + M3)
    q2, q3 = quantised(np.log10(p2)), quantised(np.log10(p3))
    rare = np.flatnonzero(own.near == RARE)
    pair1 = own.pair[rare] >> 15 << 40 | own.a[rare].astype(np.int64)
    order = np.argsort(pair1)
    at, _ = runs(pair1[order])
    pair1, n1 = pair1[order][at], np.add.reduceat(own.n[rare[order]], at) if len(rare) else np.zeros(0, np.int64)
    size1 = np.bincount(pair1 >> 40, minlength=len(words))
    to2, to3, to4, to1 = (eliasfano.encode(np.concatenate([[0], np.cumsum(s)])) for s in (size2, size3, size4, size1))
    parts = [words, counts, *to2.values(), near2.astype(np.uint16), *q2, *to3.values(), far3.astype(np.uint8), *q3, small(c2), *to4.values(), own.id, small(own.n), *to1.values(), pair1 & int(RARE_BITS), small(n1)]
    return dict(zip(LEVELS, parts, strict=True))


class Shard:
    """The levels of a shard, built from its stored counts (None: it has none)."""

    def __init__(self, head: Head, blob: bytes | None):
        self.head, self.level = head, {}
        self.back2, self.back3 = np.log10(M2 / (head.contexts.sum(1) + M2)), np.log10(M3 / (head.contexts + M3))
        p2 = (head.after_rare.sum(1) + M2 * head.first(head.count)) / (head.contexts[RARE].sum() + M2)
        self.behind = np.log10((head.after_rare + M3 * p2[:, None]) / (head.contexts[RARE] + M3))  # P3 of frequent words behind rare ones, which lie in many shards
        if blob is None:
            return
        self.level = build(head, blob)
        self.to1, self.to2, self.to3, self.to4 = ({k: self.level[f"{k}{i}"] for k in ("low", "high", "seen")} for i in (1, 2, 3, 4))

    def found(self, ids: str, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The number of each wanted id between two places of a level, 0 where it has none."""
        at = eliasfano.successor(self.level[f"id{ids}"], begin, end, wanted)
        there = at < end
        there[there] = self.level[f"id{ids}"][at[there]] == wanted[there]
        n = np.zeros(len(wanted), np.int64)
        n[there] = self.level[f"n{ids}"][at[there]]
        return n

    def ask(self, distinct: np.ndarray, per: np.ndarray, near: np.ndarray, far: np.ndarray, whole: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 P3(word | contexts) and the word's count, for queries sorted by word: distinct words and how many queries each has.

        Neighbours that are alike are looked up once: words, then word and nearer context, then all three. ``whole``: the queries' code, a and b as in ``Grams``;
        then log10 of what P divides, less that of what the next token's P is divided by, as both are known here.
        """
        own, level = self.head, self.level
        order = np.argsort(distinct)  # sorted words are found near each other
        distinct, back = distinct[order], np.argsort(order)
        place = own.places(distinct)
        count = own.count[place]
        word = np.repeat(np.arange(len(distinct)), per)
        triple, times = runs((word << 15 | near) << 3 | far)
        pair, held = runs((word << 15 | near)[triple])
        far, near, of = far[triple], near[triple[pair]], word[triple[pair]]  # of triples, of pairs, and the pair's word
        if level:
            at = np.minimum(np.searchsorted(level["words"], distinct), len(level["words"]) - 1)
            known = level["words"][at] == distinct
            count[known] = level["counts"][at[known]]
        back3 = self.back3[np.repeat(near, held), far]
        count, place = count[back], place[back]
        n2, leaf_begin, leaf_end = (np.zeros(len(x), np.int64) for x in (pair, triple, triple))
        score = np.repeat(np.log10(own.first(count))[of] + self.back2[near], held) + back3
        if level:
            begin, end = (np.zeros(len(distinct), np.int64) for _ in range(2))
            begin[known], end[known] = eliasfano.get(self.to2, at[known]), eliasfano.get(self.to2, at[known] + 1)
            begin, end = begin[back[of]], end[back[of]]
            node = eliasfano.successor(level["near"], begin, end, near)
            there = node < end
            there[there] = level["near"][node[there]] == near[there]
            n2[there] = level["n2"][node[there]]
            node, n = node[there], held[there]
            i = np.flatnonzero(np.repeat(there, held))
            score[i] = np.repeat(level["book2"][level["p2"][node]], n) + back3[i]
            a, b = (np.repeat(eliasfano.get(self.to3, x), n) for x in (node, node + 1))
            leaf = eliasfano.successor(level["far"], a, b, far[i])
            there = leaf < b
            there[there] = level["far"][leaf[there]] == far[i][there]
            score[i[there]] = level["book3"][level["p3"][leaf[there]]]
            leaf_begin[i[there]], leaf_end[i[there]] = (eliasfano.get(self.to4, leaf[there] + k) for k in (0, 1))
        after = np.repeat((place[of] > 0) & (near == RARE), held)
        score[after] = self.behind[np.repeat(place[of], held)[after], far[after]]
        score, counts = np.repeat(score, times), np.repeat(count, per)
        if whole is None:
            return score, counts
        code, a, b = whole
        near, n2 = (np.repeat(np.repeat(x, held), times) for x in (near, n2))
        n4 = np.zeros(len(score), np.int64)
        if level:
            n4 = self.found("4", np.repeat(leaf_begin, times), np.repeat(leaf_end, times), context_ids(code, a, b))
            i = np.flatnonzero((near == RARE) & known[back][word])
            row = at[back][word[i]]
            n2[i] = self.found("1", *(eliasfano.get(self.to1, row + k) for k in (0, 1)), a[i].astype(np.int64))
        one = np.where(near == RARE, ONE * n2, 0)
        score = np.where(near == BEGIN, score, np.log10(TWO * n4 + one + M4 * 10**score))
        rest = TWO * n2 + np.where(place[word] > 0, 0, ONE * counts) + M4
        return score - np.where((distinct[back] == END_HASH)[word], 0, np.log10(rest)), counts


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """``stored``; what was shuffled for it leaves the disk when it is written, as nothing reads that again."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        spark.conf.set(key, before)


def train(docs: DataFrame) -> tuple[DataFrame, Head]:
    """The shards (shard, trie) as a stored table of each shard's counts, from which its levels are built where it is asked, and what every task holds.

    The texts are read twice: for the words, then for the n-grams, whose sums give the contexts' numbers too.
    """
    spark = docs.sparkSession
    words = stored_alone(count_words(docs), "words")
    end = F.col("h") == int(END_HASH.astype(np.int64))
    total, distinct, once, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.coalesce(F.sum(F.when(end, F.col("c"))), F.lit(0))).first()
    top = words.where(~end).orderBy(F.desc("c"), "h").limit(HEAD).toPandas()  # HEAD rows at most
    own = Head(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), int(total), int(distinct), int(once), int(ends))
    shipped = spark.sparkContext.broadcast(own)

    def gather(group: pa.Table) -> pa.Table:
        own = Counts(shipped.value, group["blob"].to_pylist())
        blob, contexts = own.blob(), pack(*own.contexts())
        del own
        give_back()
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary()), "contexts": pa.array([contexts], pa.binary())})

    counted = count_grams(docs, shipped).repartition(own.shards, "shard").groupBy("shard").applyInArrow(gather, "shard int, blob binary, contexts binary")
    counted = stored_alone(counted, "grams")
    own.contexts, own.after_rare = all_contexts(counted)
    return counted.select("shard", F.col("blob").alias("trie")), own


ANSWER = "block long, head boolean, blob binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: tuple[DataFrame, Head]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``.

    Texts travel as blocks: a block sends each shard one packed row of n-grams and gets one packed row of sums back, so
    rows number blocks times shards whatever the texts hold. They are asked in ``ROUNDS`` parts by doc_id, each stored, so that the disk holds the n-grams of one part only.
    """
    tries, own = model
    shipped = docs.sparkSession.sparkContext.broadcast(own)

    def ask(batches):
        own, to = shipped.value, arrow("shard int, block long, blob binary")
        words = WordTable(own.describe)
        for k, batch in enumerate(blocks(batches)):
            g = Grams(raw(batch), words)
            ids = batch.column("doc_id")
            block = TaskContext.get().partitionId() << 32 | k  # splits of a scan are the same at every attempt
            shards, blobs = [-1 - block % own.shards], [pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), np.bincount(g.doc, minlength=batch.num_rows))]
            for s, i in dealt(g, words, own.shards):
                w, per = runs(g.at[i])
                used, where = np.unique(g.doc[i], return_inverse=True)
                shards.append(s)
                blobs.append(packed(own, words.rows[0][g.at[i[w]]], per, g.near[i], g.code[i], g.a[i], g.b[i], used.astype(np.uint16), where.astype(np.uint16)))
            yield out(to, np.array(shards, np.int32), [block] * len(shards), blobs)

    def answer(asked: pa.Table, trie: pa.Table) -> pa.Table:
        to = arrow(ANSWER)
        if not asked.num_rows:
            return to.empty_table()
        if asked["shard"][0].as_py() < 0:  # the blocks' own rows go through
            return pa.table([asked["block"], pa.array([True] * asked.num_rows), asked["blob"]], schema=to)
        own, made = Shard(shipped.value, trie["trie"][0].as_py() if trie.num_rows else None), []
        for chunk in asked["blob"].chunks:
            for blob in chunk:  # a block at a time: memory for one block and the levels
                distinct, per, near, code, a, b, used, which = unpacked(shipped.value, blob.as_py())
                s, c = own.ask(distinct, per, near, far_of(code), (code, a, b))
                made.append(pack(used, *(np.bincount(which, x, len(used)) for x in ((c > 0).astype(float), own.head.base(c), s))))
        del own
        give_back()
        return pa.table([asked["block"], pa.array([False] * len(made)), pa.array(made, pa.binary())], schema=to)

    def merge(group: pa.Table) -> pa.Table:
        head = group["head"].to_pylist().index(True)
        ids, null, n = unpack(group["blob"][head].as_py())
        sums = np.zeros((3, len(ids)))
        for i in range(group.num_rows):
            if i != head:
                used, *own = unpack(group["blob"][i].as_py())
                sums[:, used] += own
        return pa.table([pa.array(ids, mask=null.astype(bool)), pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=arrow(SCORED))

    scored = []
    for k in range(ROUNDS):
        part = docs.where(F.pmod(crc_mod("doc_id", ROUNDS), F.lit(ROUNDS)) == k)
        asked = id_and_text(part).mapInArrow(ask, "shard int, block long, blob binary")
        partial = asked.groupBy("shard").cogroup(tries.groupBy("shard")).applyInArrow(answer, ANSWER)
        scored.append(stored_alone(partial.groupBy("block").applyInArrow(merge, SCORED), "scored"))
    return reduce(DataFrame.unionByName, scored).withColumn("train_tokens", F.lit(own.total).cast("long"))


def op2_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 7) != 2))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
