"""Token files, vector codes and phrases: against the library, brute force and SQL."""

import collections
import os
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmill.llm import phrases, tokenfile, veccodes
from trailmill.llm.common import stored

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"
LONG = " ".join(random.Random(5).choice(["alpha", "beta's", "Γάμμα", "delta-9", "naïve", "中文字", "x" * 40]) for _ in range(9000))
DOCS = [(7, "Short text, with <|endoftext|> inside.", "en"), (1, None, None), (3, "", "en"), (4, LONG, "de"), (6, "twice \x1c and\x0bagain é", "fr"), (6, "twice \x1c and\x0bagain é", "fr"), (6, "other text of this id", "fr"), (None, "no id", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumn("start", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("word", F.lit("w"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfile.public_vocabulary())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, tokenfile.END]


# 11 token files


def test_files_against_the_library(spark, docs, library):
    order = sorted(((i is None, i or 0, len(ids_of(library, t)), zlib.crc32(np.array(ids_of(library, t), "<u4").tobytes()), t) for i, t, _ in DOCS), key=lambda x: x[:4])
    at, want = 0, []
    for nothing, i, n, crc, _ in order:
        want.append((None if nothing else i, at, n, crc))
        at += n
    folder = tokenfile.write(docs, tokenfile.public_vocabulary())
    assert sorted(map(tuple, tokenfile.digests(spark, folder).collect()), key=str) == sorted(want, key=str)
    read = {(r["doc_id"], r["start"]): r["ids"] for r in tokenfile.read(spark, folder).collect()}
    assert read == {(None if z else i, s): ids_of(library, t) for (z, i, _, _, t), (_, s, _, _) in zip(order, want, strict=True)}
    some = tokenfile.read(spark, folder, [4, 6, 99]).collect()
    assert sorted((r["doc_id"], r["start"], r["n_ids"]) for r in some) == sorted(w[:3] for w in want if w[0] in (4, 6))


def test_files_are_written_by_few_tasks(spark, docs, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_DOCS", 2)  # several files a range
    shared, cores, n = spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i * 7 % 300 if i % 50 else None, f"text {i % 90} of " + "many words " * (i % 11), "en") for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", 8 * cores)
    try:
        before = {*os.listdir(shared)} if os.path.isdir(shared) else set()
        folder = tokenfile.write(spark.createDataFrame(rows, SCHEMA).repartition(3 * cores), tokenfile.public_vocabulary())
        got = tokenfile.digests(spark, folder)
        names = [f"{folder.removeprefix('file:')}/files/{x}" for x in os.listdir(f"{folder.removeprefix('file:')}/files") if x.endswith(".parquet")]
        assert len(names) <= cores and got.rdd.getNumPartitions() <= cores
        assert [x.split("-")[0] for x in {*os.listdir(shared)} - before] == ["tokens"]  # no frames are left
        held = [pq.ParquetFile(x).metadata for x in names]
        assert sum(m.num_rows for m in held) > len(names) and all(m.num_row_groups == m.num_rows for m in held)
        order = sorted(((i, ids_of(library, t)) for i, t, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), zlib.crc32(np.array(r[1], "<u4").tobytes())))
        starts = np.cumsum([0, *(len(x) for _, x in order)]).tolist()
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, x), s in zip(order, starts, strict=False)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_files_of_nothing(spark, none):
    folder = tokenfile.write(none, tokenfile.public_vocabulary())
    assert tokenfile.digests(spark, folder).count() == 0 and tokenfile.read(spark, folder, [1]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_the_whole_text(text):
    from tokenizers import Tokenizer

    test_words_encode_as_the_whole_text.own = own = getattr(test_words_encode_as_the_whole_text, "own", None) or (Tokenizer.from_file(tokenfile.public_vocabulary()), tokenfile.Encoder(tokenfile.public_vocabulary()))
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(own[1].encode([text.encode()])[0], "<u2").tolist() == own[0].encode(text, add_special_tokens=False).ids


def test_a_document_is_read_alone(spark):
    """The dictionary makes short documents smaller, and a frame opens without its neighbours."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    path = tokenfile.public_vocabulary()
    dictionary = tokenfile.train_dictionary(table, path)
    assert 0 < len(dictionary) <= tokenfile.DICTIONARY_BYTES
    size = lambda d: tokenfile.frames(table.where("n_chars < 1000"), path, d).agg(F.sum(F.length("frame"))).first()[0]
    assert size(dictionary) < 0.9 * size(b"")
    folder = tokenfile.write(table, path)
    whole = {r["doc_id"]: r for r in tokenfile.read(spark, folder).collect()}
    assert [whole[i]["start"] for i in sorted(whole)] == np.cumsum([0, *(whole[i]["n_ids"] for i in sorted(whole))])[:-1].tolist()
    (one,) = tokenfile.read(spark, folder, [17]).collect()
    assert one == whole[17]


def test_damaged_files_raise():
    parts = [tokenfile.codec(b"")[0].compress(np.array(x, "<u2").tobytes()) for x in ([1, 2], [3, 4, 5])]
    good = tokenfile.bind([5, None], [2, 3], parts, 2, tokenfile.digest(b""))
    opened = tokenfile.File(good, b"")
    assert opened.ids == [5, None] and [opened.array(i).tolist() for i in (1, 0)] == [[3, 4, 5], [1, 2]]
    for bad, dictionary in ((good, b"other"), (good[:-1], b""), (good[:30], b""), (b"", b""), (b"XXXX" + good[4:], b""), (tokenfile.bind([5, 6], [2, 4], parts, 2, tokenfile.digest(b"")), b"")):
        with pytest.raises(ValueError):
            f = tokenfile.File(bad, dictionary)
            f.array(1)
    changed = bytearray(good)
    changed[-6] ^= 255
    with pytest.raises(tokenfile.zstandard.ZstdError):
        tokenfile.File(bytes(changed), b"").array(1)


# 12 vector codes


def slow_codes(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = [[int(np.floor(1024 * x)) for x in r[1]] for r in kept]
    d = len(v[0]) // parts
    cut = [[x[k * d : k * d + d] for x in v] for k in range(parts)]
    near = lambda x, book: min(((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book)))
    books = [cut[k][:entries] for k in range(parts)]
    for _ in range(rounds):
        for k in range(parts):
            own = collections.defaultdict(list)
            for x in cut[k]:
                own[near(x, books[k])[1]].append(x)
            books[k] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else b for e, b in enumerate(books[k])]
    got = [[near(cut[k][i], books[k]) for k in range(parts)] for i in range(len(v))]
    return [(r[0], r[2], "".join(f"{e:02x}" for _, e in g), sum(x for x, _ in g)) for r, g in zip(kept, got)], books


def vectors(n=330, dims=8, kinds=40, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(kinds, dims))
    rows = [(i, [float(x) for x in np.float32(base[i % kinds] + (0.05 * rng.normal(size=dims) if i % 3 else 0))], i % 5 if i % 7 else None) for i in range(n)]
    return [*rows, (n, None, 1), (n + 1, [1.0] * (dims - 1) + [None], 1), (n + 2, [float("nan")] * dims, None), (n + 3, [float("inf")] + [0.0] * (dims - 1), 2), rows[4], rows[5], (None, [0.25] * dims, None)]


def test_codes_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash"))
    for parts, entries, rounds, block in ((4, 256, 2, None), (2, 20, 4, 64)):
        if block:
            veccodes.BLOCK, before = block, veccodes.BLOCK
        held, books = veccodes.train(df.repartition(3), parts, entries, rounds)
        if block:
            veccodes.BLOCK = before
        want, slow = slow_codes(rows, parts, entries, rounds)
        assert books.tolist() == slow
        coded = veccodes.encode(held, books)
        assert sorted(map(tuple, coded.collect()), key=str) == sorted(want, key=str)
        error = collections.Counter()
        for _, label, _, e in want:
            error[label] += e
        for sent in (50_000, 0):
            assert {(r["label"], r["label_error"]) for r in veccodes.with_label_errors(coded, sent).collect()} == set(error.items())


def test_balls_are_owned_whole():
    """Where points lie in clumps, most balls belong to one entry, and what is looked at one by one is little; every answer is the nearest entry."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (12, 6))
    points = (centres[rng.integers(0, 12, 2000)] + rng.integers(-30, 30, (2000, 6))).astype(np.int64)
    tree, book = veccodes.Tree.unpack(veccodes.build(points).pack()), np.concatenate([centres, centres[:3]])
    whole, rows, _ = veccodes.owners(tree, book)
    assert len(rows) <= 0.3 * len(points) and sum(int(tree.hi[b] - tree.lo[b]) for b, _ in whole) + len(rows) == len(points)
    nearest = ((points[:, None] - book[None]) ** 2).sum(2)
    got, error = veccodes.codes(tree, book)
    assert (got == nearest.argmin(1)).all() and (error == nearest.min(1)).all()
    assert sorted(tree.order.tolist()) == list(range(2000))
    for b in range(len(tree.lo)):
        own = points[tree.order[tree.lo[b] : tree.hi[b]]]
        assert (own.sum(0) == tree.total[b]).all() and (np.sqrt(((own - tree.pivot[b]) ** 2).sum(1)) <= tree.radius[b] + 1e-9).all()


def test_large_components_are_exact():
    points = np.random.default_rng(2).integers(-(1 << 28), 1 << 28, (300, 4))
    book = points[:7].copy()
    nearest = ((points[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
    got, error = veccodes.codes(veccodes.Tree.unpack(veccodes.build(points).pack()), book)
    assert got.tolist() == [int(np.argmin(list(x))) for x in nearest] and error.tolist() == [min(x) for x in nearest.tolist()]


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert veccodes.train(df)[1] is None
    bad = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], df.schema)
    with pytest.raises(Exception, match="4 parts divide"):
        veccodes.train(bad)
    same = spark.createDataFrame([(i, [0.5] * 4, None) for i in range(300)], df.schema)
    held, books = veccodes.train(same)
    assert {(r["code"], r["error"]) for r in veccodes.encode(held, books).collect()} == {("00000000", 0)}


def test_codes_against_sql(spark):
    c = duckdb.connect()
    rows = vectors(300, 8)[:304]
    frame = pd.DataFrame([(i, v, lb) for i, v, lb in rows], columns=["vec_id", "embedding", "label"]).astype({"label": "Int64"})
    c.register("e0", frame)
    c.execute("CREATE TABLE embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding, label FROM e0")
    want = c.execute(veccodes.OP12_SQL).df()
    held, books = veccodes.train(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = veccodes.with_label_errors(stored(veccodes.encode(held, books), "codes")).toPandas()
    assert sorted(zip(got.vec_id, got.code, got.error, got.label_error)) == sorted(zip(want.vec_id, want.code, want.error, want.label_error))
    assert set(want.codebooks_sha256) == {veccodes.books_digest(books)}


# 13 phrases


def slow_phrases(rows, least=10, percent=50, top=2000):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and p in (q[:2], q[1:]) for q, b in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def chatter(n=500, seed=8):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hot", "dog", "é", "x\0y", "a", "b"]
    rows = []
    for i in range(n):
        said = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", ". ", ",", "\r\n", "  "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, said + rng.choice(["", "New York City ", "hot dog; ", "the the the the "]), rng.choice(["en", "en", "en", "de", None, "und", "x\0y"])))
    return [*rows, rows[3], (None, None, None), (1, "", "en"), (2, " ".join(["of the new", "york"] * 900), "en")]


@pytest.mark.parametrize(("least", "top", "places", "fan_out"), [(10, 2000, 500_000, 2048), (10, 7, 400, 8), (3, 50, 900, 2048)])
def test_phrases_against_brute_force(spark, least, top, places, fan_out):
    """With few rows a place nearly every word is frequent, so all three kinds of routes are taken; with a small fan-out rows are dealt in several steps."""
    rows = chatter()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).repartition(3)
    got = phrases.collocations(df, least=least, top=top, place_rows=places, fan_out=fan_out)
    assert sorted(map(tuple, got.collect())) == slow_phrases(rows, least=least, top=top)


def test_phrases_are_written_by_few_tasks(spark):
    folder, cores = spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), spark.sparkContext.defaultParallelism
    before, n = {*os.listdir(folder)} if os.path.isdir(folder) else set(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8 * cores)
    try:
        rows = chatter(300)
        got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3 * cores), least=2)
        assert sorted(map(tuple, got.collect())) == slow_phrases(rows, least=2) and got.rdd.getNumPartitions() <= cores
        files = {f.split("-")[0]: sum(x.endswith(".parquet") for x in os.listdir(f"{folder}/{f}")) for f in {*os.listdir(folder)} - before}
        assert {*files} == {"words", "phrases", "ranges"} and max(files.values()) <= cores, files
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_phrases_of_nothing(spark, none, docs):
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(docs.limit(3)).count() == 0
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == slow_phrases(DOCS)


def test_phrases_against_sql(spark):
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(chatter(300), columns=["doc_id", "text", "lang"]))
    want = sorted(c.execute(phrases.OP13_SQL).fetchall())
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(chatter(300), SCHEMA)).collect())) == want and len(want) > 20


def test_quicksort_counts_and_abandons():
    rng = np.random.default_rng(0)
    keys, weight = [rng.integers(-1, 6, 3000) for _ in range(3)], rng.integers(1, 4, 3000)
    for least in (1, 40):
        for depth, at, edges, sizes in phrases.quicksort(keys, weight, least):
            want = collections.Counter()
            for i in range(3000):
                want[tuple(k[i] for k in keys[: depth + 1])] += int(weight[i])
            got = {}
            for a, b, s in zip(edges[:-1], edges[1:], sizes, strict=True):
                (same,) = {tuple(k[i] for k in keys[: depth + 1]) for i in at[a:b]}
                got[same] = int(s)
            assert got == {k: v for k, v in want.items() if v >= least}


def test_scores_are_exact(spark):
    a, left, right = 10**14 + 7, 10**14 + 9, 10**15 - 1
    df = spark.createDataFrame([(a, left, right), (10, 10, 10)], "a long, l long, r long").select(phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r["s"] for r in df.collect()] == [1_000_000 * a * a // (left * right), 1_000_000]
