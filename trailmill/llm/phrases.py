"""Phrases whose words go together more often than by chance.

Suffixes are word places: a phrase is the first words of a suffix, which ends before a word too rare for any phrase (a filter of fixed size tells most of them). Each task
sorts the suffix pointers of a block by multikey three-way quicksort to the depth of the longest phrase, so that equal suffixes become one row with their number. Rows then go, packed, to one place
for each leading word of a language; a word so frequent that its suffixes would crowd a place is routed by two leading
words, and where both are so frequent by three, with the number of such pairs sent as rows of their own. There the same
sort runs over the rows: partitions of equal words are phrases, their sizes are the counts, and partitions that are too small are
abandoned before they are sorted any deeper.

    lower-case A-Z; pieces end at . , ; : ! ? and line ends; words are runs of anything but space and tab

Null text: empty. Null lang: ``und``. doc_id is not used: repeated rows count each time. A text of any length is handled
whole, in its block. Scores are whole numbers of exact (decimal) arithmetic; ties go by count, then by the phrase's
bytes. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import arrow, cut_words, mix, out, pieces, raw, small_batches, table
from trailmill.operators.ordering import numbered_within
from trailmill.shared import stored

LEAST, INSIDE_PERCENT, TOP = 10, 50, 2000
#: Text bytes sorted at once; suffixes that a place is meant for; a word is frequent from 1 / FREQUENT of a place's share.
BLOCK_BYTES, PLACE_ROWS, FREQUENT = 4_000_000, 500_000, 8
#: Places whose phrases lie in one file, where there are more places than cores.
PLACES_A_FILE = 64

#: What a byte is: 0 part of a word, 1 between words, 2 between pieces; and A-Z in lower case.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
ENDS = KIND == 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """All words of the texts, the number of piece ends before each, and the text that each is of."""
    words, starts, text, data = cut_words(texts, KIND > 0, LOWER)
    return words, np.searchsorted(np.flatnonzero(ENDS[data]), starts), text


def quicksort(keys: list[np.ndarray], weight: np.ndarray, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of the pointers 0..n-1 by keys[0], keys[1], ...

    For each depth it gives (depth, pointers, edges, sizes): the partitions equal down to that depth, each a range of ``pointers``, and the
    sum of their weights. Partitions below ``least`` are abandoned, whether equal or not yet told apart. All partitions
    of a depth take a step together: a pivot each, and three groups, of which the equal one is done; no order between groups is kept, since only equality counts.
    """
    active, group, n_groups = np.arange(len(weight), dtype=np.int32), np.zeros(len(weight), np.int32), 1
    heavy = None if (weight == 1).all() else weight
    for depth, key in enumerate(keys):
        done, done_group, n_done, sizes = [], [], 0, np.bincount(group, minlength=n_groups)
        while len(active):
            edges = np.concatenate([[0], np.cumsum(sizes)])
            own = key[active]
            a, b, c = own[edges[:-1]], own[(edges[:-1] + edges[1:]) // 2], own[edges[1:] - 1]
            pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))  # the median of three
            pivot = np.repeat(pivot, sizes)
            below, above = own < pivot, own > pivot
            equal = ~(below | above)
            done.append(active[equal])
            done_group.append(group[equal] + np.int32(n_done))
            n_done += n_groups
            active, group = np.concatenate([active[below], active[above]]), np.concatenate([group[below], group[above] + np.int32(n_groups)])
            active, group, n_groups, sizes, _ = _kept(active, group, 2 * n_groups, heavy, least)
        active, group = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (done, done_group))
        active, group, n_groups, sizes, weights = _kept(active, group, n_done, heavy, least)
        yield depth, active, np.concatenate([[0], np.cumsum(sizes)]), weights


def _kept(active: np.ndarray, group: np.ndarray, n: int, weight: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """Without the groups below ``least`` (and empty ones), which lie one after the other in the order of their numbers; the others numbered anew, with their numbers of pointers and their weights. No weight: each counts once."""
    sizes = np.bincount(group, minlength=n)
    weights = sizes if weight is None else np.bincount(group, weight[active], n).astype(np.int64)
    stays = weights >= max(least, 1)
    if not stays.all():
        held = np.repeat(stays, sizes)
        again = (np.cumsum(stays) - 1).astype(np.int32)
        active, group = active[held], again[group[held]]
    return active, group, int(stays.sum()), sizes[stays], weights[stays]


def with_lang(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: how often each word occurs, and in a row with null word all words of the language."""

    def run(batches):
        to = arrow("lang string, word string, n long")
        for b in pieces(batches, most=BLOCK_BYTES):
            words, _, text = words_of(texts_of(b))
            langs = b.column("lang").dictionary_encode()
            n_words = max(len(words.dictionary), 1)
            both = np.asarray(langs.indices, np.int64)[text] * n_words + np.asarray(words.indices, np.int64)
            found, n = np.unique(both, return_counts=True)
            totals = np.bincount(found // n_words, n, len(langs.dictionary)).astype(np.int64)
            named = pa.concat_arrays([words.dictionary.take(pa.array(found % n_words)).cast(pa.string()), pa.nulls(len(totals), pa.string())])
            yield out(to, langs.dictionary.take(pa.array(np.concatenate([found // n_words, np.arange(len(totals))]))), named, np.concatenate([n, totals]))

    return with_lang(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


#: Kinds of rows: a suffix; a suffix whose first two words are both frequent, which gives no pair; the number of such a pair.
PLAIN, TRIPLE, PAIR = 0, 1, 2
#: Bits of the filter of words that are not rare: so many for each such word, within these powers of two. It may pass a rare word, never stop another.
BITS_A_WORD, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Bins that one step deals a block's rows to, a fixed number, so that packed rows grow as the blocks; and bins that a place has at least, so that places are even.
#: More places than that are reached by another step, which deals each bin's rows again.
FAN_OUT, BINS = 2048, 4


def hashes(by_lang: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    return mix(by_lang + np.uint64(31) * by_word)


def digests(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


def common_words(words: DataFrame, n: int) -> np.ndarray:
    """The filter: a bit for the hash of each word in its language. At most MOST_BITS, whatever the corpus; what tasks have set is put together by Spark."""
    bits = min(max(1 << (BITS_A_WORD * n - 1).bit_length(), FEWEST_BITS), MOST_BITS)

    def run(batches):
        to, cells = arrow("cell int, bits long"), np.zeros(bits // 64, np.uint64)
        for b in batches:
            h = hashes(digests(raw(b, "lang")), digests(raw(b, "word"))) & np.uint64(bits - 1)
            np.bitwise_or.at(cells, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
        found = np.flatnonzero(cells)
        for i in range(0, len(found), 65_536):
            yield out(to, found[i : i + 65_536].astype(np.int32), cells[found[i : i + 65_536]].view(np.int64))

    rows = words.select("lang", "word").mapInArrow(run, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(bits // 64, np.int64)
    cells[np.asarray(rows.column("cell"))] = np.asarray(rows.column("bits"))
    return cells.view(np.uint64)


PACKED = "bin long, lang string, packed binary"


def packs(bins: np.ndarray, lang: np.ndarray, langs: pa.Array, routes: np.ndarray, kinds: np.ndarray, n: np.ndarray, said: pa.Array) -> pa.RecordBatch:
    """Rows in the order of bin and language, as a row for each bin and language."""
    pressed = zstandard.ZstdCompressor(level=1)
    starts = np.flatnonzero((np.diff(bins, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
    lines = pc.binary_join_element_wise(said, b"", b"\n")  # a line end after each, so a range of rows is a range of bytes
    at, data = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, 4 * lines.offset), memoryview(lines.buffers()[2])
    kinds, n = kinds.astype(np.uint8), n.astype("<i8")
    packed = [pressed.compress(pack(routes[i:j], kinds[i:j], n[i:j], data[at[i] : at[j] - 1])) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(bins)], strict=True)]
    return out(arrow(PACKED), bins[starts], langs.take(pa.array(lang[starts])), packed)


def routed(docs: DataFrame, frequent: dict[str, list[str]], common: np.ndarray, fan_out: int, more: bool) -> DataFrame:
    """bin, lang, packed: distinct suffixes of each block with their number, those of one bin and language packed together. ``more``: whether bins are dealt again, for which rows keep their route.

    A rare word can't be in a phrase that counts: a suffix ends before it, and suffixes of one word are left out, since words are counted already.
    """
    sent = docs.sparkSession.sparkContext.broadcast((frequent, common))  # FREQUENT words for each place, and MOST_BITS

    def run(batches):
        often, common = sent.value
        often = {k: pa.array([w.encode() for w in v], pa.binary()) for k, v in often.items()}
        mask = np.uint64(64 * len(common) - 1)
        for b in pieces(batches, most=BLOCK_BYTES):
            words, piece, text = words_of(texts_of(b))
            known = words.dictionary
            if len(words) < 2:
                continue
            langs = b.column("lang").dictionary_encode()
            lang = np.asarray(langs.indices, np.int64)[text]
            one = np.asarray(words.indices, np.int64)
            by_word, by_lang = np.append(digests(known.to_pylist()), np.uint64(0)), digests([x.encode() for x in langs.dictionary.to_pylist()])
            route = hashes(by_lang[lang], by_word[one])
            bit = route & mask
            real = (common[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            two, three = np.full(len(one), -1), np.full(len(one), -1)
            two[:-1] = np.where((piece[1:] == piece[:-1]) & real[1:], one[1:], -1)
            three[:-2] = np.where((piece[2:] == piece[:-2]) & real[2:], one[2:], -1)
            keep = np.flatnonzero(real & (two >= 0))
            if not len(keep):
                continue
            lang, one, two, three, route = lang[keep], one[keep], two[keep], three[keep], route[keep]
            *_, (_, at, edges, n) = quicksort([lang * len(known) + one, two, three], np.ones(len(one)))
            first = at[edges[:-1]]  # one suffix of each kind stands for all
            lang, one, two, three, route = lang[first], one[first], two[first], three[first], route[first]
            hot = [np.flatnonzero(np.asarray(pc.is_in(known, often[name]))) + i * len(known) for i, name in enumerate(langs.dictionary.to_pylist()) if name in often]
            hot = np.concatenate(hot) if hot else np.zeros(0, np.int64)
            hot_one, hot_two = np.isin(lang * len(known) + one, hot), np.isin(lang * len(known) + two, hot)
            pair_route = mix(route + by_word[two])
            kind = np.where(hot_one & hot_two, TRIPLE, PLAIN)
            route = np.where(kind == TRIPLE, mix(pair_route + by_word[three]), np.where(hot_one, pair_route, route))
            # pairs of frequent words: their number in this block
            own = np.flatnonzero(kind == TRIPLE)
            both = (lang[own] * len(known) + one[own]) * len(known) + two[own]
            _, where, which = np.unique(both, return_index=True, return_inverse=True)
            total, pair = np.bincount(which, n[own], len(where)).astype(np.int64), own[where]
            plain = np.flatnonzero((kind == PLAIN) | (three >= 0))  # a hot pair at the end of a piece is in the pair's number
            rows, kinds = np.concatenate([plain, pair]), np.concatenate([kind[plain], np.full(len(pair), PAIR)])
            route = np.concatenate([route[plain], pair_route[pair]])
            to_bin = (route % np.uint64(fan_out)).astype(np.int64)
            order = np.lexsort((one[rows], lang[rows], to_bin))
            rows, kinds, to_bin, n = rows[order], kinds[order], to_bin[order], np.concatenate([n[plain], total])[order]
            third = np.where(kinds == PAIR, -1, three[rows])
            word = lambda ids: known.take(pa.array(ids, mask=ids < 0))
            said = pc.binary_join_element_wise(word(one[rows]), word(two[rows]), word(third), b" ", null_handling="skip")
            yield packs(to_bin, lang[rows], langs.dictionary, route[order] // np.uint64(fan_out) if more else NO_ROUTE, kinds, n, said)

    return with_lang(docs).mapInArrow(run, PACKED)


NO_ROUTE = np.zeros(0, np.uint64)


def pack(routes: np.ndarray, kinds: np.ndarray, n: np.ndarray, lines: bytes | memoryview) -> bytes:
    """Routes (or none), kinds, numbers and phrases of rows; no word holds a line end, so that may part the phrases."""
    return b"".join([len(n).to_bytes(4, "little"), len(routes).to_bytes(4, "little"), routes.tobytes(), kinds.tobytes(), n.tobytes(), lines])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    m, r = np.frombuffer(data, np.uint32, 2).tolist()
    at = 8 + 8 * r
    return np.frombuffer(data, np.uint64, r, 8), np.frombuffer(data, np.uint8, m, at), np.frombuffer(data, "<i8", m, at + m), data[at + 9 * m :]


#: Rows that a step deals at once.
STEP_ROWS = 500_000


def dealt_again(binned: DataFrame, fan_out: int, more: bool) -> DataFrame:
    """The same rows, each bin's dealt to ``fan_out`` bins of its own by what is left of their routes."""

    def run(batches):
        opened, held, size = zstandard.ZstdDecompressor(), [], 0

        def dealt(some: list) -> pa.RecordBatch:
            langs = pa.array([x[1] for x in some], pa.string()).dictionary_encode()
            sizes = [len(x[3]) for x in some]
            routes, kinds, n = (np.concatenate([x[k] for x in some]) for k in (2, 3, 4))
            bins = np.repeat([x[0] for x in some], sizes) * fan_out + (routes % np.uint64(fan_out)).astype(np.int64)
            lang = np.repeat(np.asarray(langs.indices, np.int64), sizes)
            said = pa.array([w for x in some for w in x[5].split(b"\n")], pa.binary())
            order = np.lexsort((lang, bins))
            return packs(bins[order], lang[order], langs.dictionary, routes[order] // np.uint64(fan_out) if more else NO_ROUTE, kinds[order], n[order], said.take(pa.array(order)))

        for b in batches:
            for k, name, packed in zip(b.column("bin").to_pylist(), b.column("lang").to_pylist(), b.column("packed"), strict=True):
                held.append((k, name, *unpack(opened.decompress(packed.as_buffer()))))
                size += len(held[-1][3])
                if size >= STEP_ROWS:
                    yield dealt(held)
                    held, size = [], 0
        if held:
            yield dealt(held)

    return binned.mapInArrow(run, PACKED)


def at_places(docs: DataFrame, frequent: dict[str, list[str]], common: np.ndarray, places: int, fan_out: int) -> DataFrame:
    """lang, packed: all rows of one route in one partition. One step for each power of ``fan_out`` in the places; packed rows grow as the input in each."""
    steps, reach = 1, fan_out
    while reach < BINS * places:
        steps, reach = steps + 1, reach * fan_out
    got = routed(docs, frequent, common, fan_out, steps > 1)
    for k in range(1, steps):
        parts = max(1, places // fan_out**k)  # of a bin, by nothing but chance
        got = dealt_again(got.repartition(places, "bin", F.pmod(F.xxhash64("packed"), F.lit(parts))), fan_out, k + 1 < steps)
    return got.repartition(places, "bin").drop("bin")


def frequent_phrases(binned: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3 (null: a pair), a: phrases of two and three words that occur ``least`` times or more, from rows that are dealt already."""
    schema = "lang string, w1 string, w2 string, w3 string, a long"

    def run(batches):
        langs, sizes, kinds, numbers, said, opened = [], [], [], [], [], zstandard.ZstdDecompressor()
        for b in batches:
            for name, packed in zip(b.column("lang").to_pylist(), b.column("packed"), strict=True):
                _, k, n, text = unpack(opened.decompress(packed.as_buffer()))
                langs.append(name)
                sizes.append(len(n))
                kinds.append(k)
                numbers.append(n)
                said.append(text)
        if not langs:
            return
        to, kind, n = arrow(schema), np.concatenate(kinds), np.concatenate(numbers)
        names = pa.array(langs, pa.string()).dictionary_encode()
        lang = np.repeat(np.asarray(names.indices, np.int64), sizes)
        words, row, _ = words_of([b"\n".join(said)])  # a phrase a line, and its words in order
        del said
        ids, known = np.asarray(words.indices, np.int64), words.dictionary
        start = np.searchsorted(row, np.arange(len(n)))
        length = np.diff(np.append(start, len(ids)))
        third = np.where(length == 3, ids[np.minimum(start + 2, len(ids) - 1)], -1)
        keys = [lang * len(known) + ids[start], ids[start + 1], third]
        for depth, at, edges, _ in quicksort(keys, n, least):
            if not depth or not len(at):
                continue
            own = np.where(kind[at] == (TRIPLE if depth == 1 else PAIR), 0, n[at])
            a, first = np.add.reduceat(own, edges[:-1]), at[edges[:-1]]
            real = (a >= least) & (third[first] >= 0 if depth == 2 else True)
            first, a = first[real], a[real]
            word = lambda x: known.take(pa.array(x)).cast(pa.string())
            yield out(to, names.dictionary.take(pa.array(lang[first])), word(ids[start[first]]), word(ids[start[first] + 1]), word(third[first]) if depth == 2 else pa.nulls(len(a), pa.string()), a)

    return binned.mapInArrow(run, schema)


def look_up(rows: DataFrame, counts: DataFrame, keys: list[str], counted: list[str], name: str, frequent_from: int) -> DataFrame:
    """Adds ``name``: n of the row of ``counts`` (unique by ``counted``) whose columns equal ``keys``.

    Counts of ``frequent_from`` and more are few, whatever the table (they divide all occurrences), and go to every task; rows that they serve would be
    hot keys of the join with all others, and are strewn by a hash there, where they need no partner.
    """
    some = counts.select(*(F.col(c).alias(f"_{c}") for c in counted), F.col("n").alias("_n"))
    same = lambda: [F.col(k) == F.col(f"_{c}") for k, c in zip(keys, counted, strict=True)]
    got = rows.join(F.broadcast(some.where(F.col("_n") >= frequent_from)), same(), "left").withColumnRenamed("_n", name).drop(*(f"_{c}" for c in counted))
    got = got.withColumn("_strewn", F.when(F.col(name).isNotNull(), F.xxhash64(*rows.columns)).otherwise(0))
    rest = some.where(F.col("_n") < frequent_from).withColumn("_zero", F.lit(0).cast("long"))
    got = got.join(rest, [*same(), F.col("_strewn") == F.col("_zero"), F.col(name).isNull()], "left")
    return got.withColumn(name, F.coalesce(name, "_n")).drop("_n", "_strewn", "_zero", *(f"_{c}" for c in counted))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact up to counts of 10^15."""
    wide = lambda x: x.cast("decimal(15,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", top, wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP, place_rows: int = PLACE_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or three words."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    counted = stored(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()), "words", cores)
    langs, words = counted.where("word IS NULL").select(F.col("lang").alias("of"), F.col("n").alias("all_words")), counted.where("word IS NOT NULL")
    total = langs.agg(F.coalesce(F.sum("all_words"), F.lit(0))).first()[0]
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // place_rows))
    files = max(cores, places // PLACES_A_FILE)
    often = max(least, total // (FREQUENT * places))
    frequent: dict[str, list[str]] = {}
    for r in words.where(F.col("n") >= often).select("lang", "word").collect():  # at most FREQUENT for each place
        frequent.setdefault(r["lang"], []).append(r["word"])
    common = common_words(words, words.count())
    found = stored(frequent_phrases(at_places(docs, frequent, common, places, fan_out), least), "phrases", files)
    pairs = found.where("w3 IS NULL").select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("a").alias("n"))
    ends = look_up(found.withColumn("last", F.coalesce("w3", "w2")), words, ["lang", "w1"], ["lang", "word"], "f1", often)
    ends = look_up(ends, words, ["lang", "last"], ["lang", "word"], "f_last", often)
    longer = look_up(look_up(ends.where("w3 IS NOT NULL"), pairs, ["lang", "w1", "w2"], ["lang", "x", "y"], "f12", often), pairs, ["lang", "w2", "w3"], ["lang", "x", "y"], "f23", often)
    early, late = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f_last"))
    longer = longer.withColumn("s1", early).withColumn("s2", late)
    cut = lambda one, two: F.when(F.col("s1") <= F.col("s2"), one).otherwise(two)
    longer = longer.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut(F.col("f1"), F.col("f12")).alias("l"), cut(F.col("f23"), F.col("f_last")).alias("r"), F.least("s1", "s2").alias("score"))
    around = found.where("w3 IS NOT NULL").select("lang", "a", F.explode(F.array(F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")), F.struct(F.col("w2").alias("x"), F.col("w3").alias("y")))).alias("p"))
    around = around.groupBy(F.col("lang").alias("_lang"), F.col("p.x").alias("_x"), F.col("p.y").alias("_y")).agg(F.max("a").alias("most"))
    short = ends.where("w3 IS NULL").join(around, (F.col("lang") == F.col("_lang")) & (F.col("w1") == F.col("_x")) & (F.col("w2") == F.col("_y")), "left")
    short = short.where(F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a")))
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f_last").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f_last")).alias("score"))
    ranked = numbered_within(longer.unionByName(short), ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "rank", files=files).where(F.col("rank") < top)
    few = langs.limit(50_001).count() <= 50_000  # a row for each language
    if few:
        ranked = ranked.repartition(cores)  # ``top`` rows of each language, that many tasks need not write
    return ranked.join(F.broadcast(langs) if few else langs, F.col("lang") == F.col("of")).select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM cut),
s AS MATERIALIZED (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM s GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM s WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, p.f AS l, q.f AS r FROM f2 c JOIN f1 p ON p.lang = c.lang AND p.w1 = c.w1 JOIN f1 q ON q.lang = c.lang AND q.w1 = c.w2
  WHERE c.f >= {LEAST} AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND 100 * t.f >= {INSIDE_PERCENT} * c.f AND (t.w1 = c.w1 AND t.w2 = c.w2 OR t.w2 = c.w1 AND t.w3 = c.w2))
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, p.f, q.f FROM f3 c JOIN f1 p ON p.lang = c.lang AND p.w1 = c.w1 JOIN f2 q ON q.lang = c.lang AND q.w1 = c.w2 AND q.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, p.f, q.f FROM f3 c JOIN f2 p ON p.lang = c.lang AND p.w1 = c.w1 AND p.w2 = c.w2 JOIN f1 q ON q.lang = c.lang AND q.w1 = c.w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
