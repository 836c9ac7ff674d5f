"""Damaged chunks, keys joined in one run, and pipeline stages on odd tables."""

import collections
import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm import bpe, lm, media, neardup, secrets
from trailmill.llm.common import stored

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 4 media


@pytest.fixture(scope="module")
def chunked(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(rng.choice(string.ascii_letters) for _ in range(40_000))) for i in range(3)], "doc_id long, text string")
    return stored(media.chunk_lists(docs), "lists"), stored(media.chunk_store(docs), "store")


@pytest.mark.parametrize(
    ("what", "said"),
    [
        ("lost", "missing from the store"),
        ("changed", "does not match its digest"),
        ("misordered", "does not match its payload's key"),
        ("dropped from the list", "does not match its payload's key"),
    ],
)
def test_damaged_chunks_raise(chunked, what, said):
    import bz2

    lists, store = chunked
    one = store.orderBy("digest").first()
    if what == "lost":
        store = store.where(F.col("digest") != F.lit(one["digest"]))
    elif what == "changed":
        store = store.withColumn("packed", F.when(F.col("digest") == F.lit(one["digest"]), F.lit(bz2.compress(b"other"))).otherwise(F.col("packed")))
    elif what == "misordered":
        lists = lists.withColumn("digests", F.reverse("digests"))
    else:
        lists = lists.withColumn("digests", F.slice("digests", 1, F.size("digests") - 1))
    with pytest.raises(Exception, match=said):
        media.rebuild(lists, store).collect()


# 5 secrets


def test_keys_joined_in_one_run(spark):
    """Many keys in one run with plain words between: a part that is no key as a whole is searched inside."""
    rng, rows = random.Random(5), []
    kinds = {"hex 20": ("0123456789abcdef", 20, 0.8), "hex 23": ("0123456789abcdef", 23, 0.9), "base 62, 20": (string.ascii_letters + string.digits, 20, 0.95)}
    for kind, (chars, size, _) in kinds.items():
        for n in (1, 5, 10, 50):
            for _ in range(100 // n + 2):
                keys = ["".join(rng.choice(chars) for _ in range(size)) for _ in range(n)]
                rows.append((len(rows), kind, n, "the_" + "_the_plain_words_here_".join(keys) + "_end", keys))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    ratio = secrets.train(docs)
    found = {r["doc_id"]: r["spans"] for r in secrets.find(spark.createDataFrame([(i, t) for i, _, _, t, _ in rows], "doc_id long, text string"), ratio).collect()}
    for kind, (_, size, least) in kinds.items():
        for n in (1, 5, 10, 50):
            hit = total = 0
            for i, k, m, text, keys in rows:
                if (k, m) == (kind, n):
                    spans = [tuple(map(int, s.split(":")[1:])) for s in found[i].split(",") if s]
                    total += n
                    hit += sum(sum(max(0, min(b, at + size) - max(a, at)) for a, b in spans) >= 0.8 * size for at in map(text.index, keys))
            assert hit >= least * total, (kind, n, hit, total)
    assert secrets.find(docs, ratio).agg(F.sum("n_random")).first()[0] == 0


# pipeline


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns that clash with names used inside, null and repeated ids, empty and repeated texts, and a very long one."""
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, prose(80, 1), "en", "s", 1), (None, prose(80, 1), "en", "s", 1), (9003, prose(80, 2), "en", "s", 1), (9003, prose(80, 2), "en", "t", 2), (9003, prose(80, 2), "en", "t", 2), (9004, prose(60_000, 3), "en", "s", 1)],
        own.schema,
    )
    rows = own.unionByName(more)
    for c in ("row", "rep", "_rows", "digest", "score", "quality_score", "found", "spans", "band"):
        rows = rows.withColumn(c, F.lit("clash"))
    return stored(rows, "odd")


def test_stages_on_odd_tables(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = odd
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, stored(stage(spark, kept, SF), "odd")
        assert kept.columns == odd.columns and dict(kept.dtypes) == dict(odd.dtypes), name
        assert kept.count() <= before.count() and {r["row"] for r in kept.select("row").distinct().collect()} == {"clash"}
        if name == "MinHash near-dedup":
            ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
            assert ids.count(9003) <= 1 and ids.count(None) == before.where("doc_id IS NULL").count() and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
        empty = stage(spark, odd.limit(0), SF)
        assert empty.columns == odd.columns and empty.count() == 0, name
    last = pipeline.STAGES[-1][1]
    assert last(spark, kept, SF).count() == kept.count() and last(spark, odd.limit(0), SF).count() == 0


def test_one_row_of_each_class_stays(spark, odd):
    """Of an id's several rows the first by text and then by all columns, whatever the partitions."""
    got = [sorted((r["doc_id"] or 0, r["source"] or "") for r in neardup.keep_one(odd.repartition(n)).collect()) for n in (2, 5)]
    assert got[0] == got[1] and [s for i, s in got[0] if i == 9003] == ["s"]


def test_near_copies_of_one_group_meet_before_all_pairs_do(spark, monkeypatch):
    rng, words = random.Random(11), [f"w{i}" for i in range(3000)]
    base, made = [rng.choice(words) for _ in range(150)], []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice((1, 2, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice(words)
        made.append((k, " ".join(w)))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in made]
    root = list(range(150))
    for a in range(150):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    rows, across = [], neardup.across

    def counted(rest, near):
        rows.append((got := across(rest, near)).count())
        return got

    monkeypatch.setattr(neardup, "across", counted)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))
    assert sum(rows) <= 300


def test_codec_keeps_no_pre_tokens_after_a_task(spark):
    def kept(batches):
        import pyarrow as pa

        for b in batches:
            c = bpe.codec(*bpe.public_vocabulary())
            yield pa.RecordBatch.from_pydict({"n": [len(c.new) + len(c.old)] * b.num_rows})

    rows = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string").coalesce(1)
    ids = stored(bpe.encode(rows, *bpe.public_vocabulary()), "ids")
    assert [r["text"] for r in bpe.decode(ids, *bpe.public_vocabulary()).collect()] == ["some words of a text"]
    after = spark.range(64).repartition(16).mapInArrow(kept, "n long").collect()
    assert {r["n"] for r in after} == {0}


def test_contexts_beyond_the_classes_are_counted_whole(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)).encode() for _ in range(20)]
    tokens = [w for t in texts for w in [*t.split(), lm.END]]
    hashes = lm.hashes(sorted({*tokens}))[0]
    head = lm.Head(hashes[:9], hashes[:9] * 0 + 1, len(tokens), len(hashes), 0)  # 9 of 61 words have classes of their own
    at, near, far, doc = lm.grams(texts, lm.WordTable(head.describe))
    assert len(at) == len(near) == len(far) == len(doc) == len(tokens)  # a row for each token, none dropped
    code = [int(c) for c in head.describe(tokens)[1]]
    want_near, want_far, begins = [], [], True
    for i, w in enumerate(tokens):
        want_near.append(lm.BEGIN if begins else code[i - 1])
        before = lm.BEGIN if begins or want_near[-2] == lm.BEGIN else code[i - 2]
        want_far.append(lm.FAR + 2 if before == lm.BEGIN else min(before, lm.FAR + 1))
        begins = w == lm.END
    assert near.tolist() == want_near and far.tolist() == want_far


def test_contexts_are_sums_over_the_shards(spark):
    """Training reads the texts twice; the contexts' numbers, which a third reading gave, are those of the tokens themselves."""
    rng, read = random.Random(8), spark.sparkContext.accumulator(0)
    texts = ["", "one", *(" ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(1, 60))) for _ in range(80))]

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).mapInArrow(counted, "doc_id long, text string")
    _, head = lm.train(docs)
    assert read.value == 2 * len(texts)
    _, near, far, _ = lm.grams([t.encode() for t in texts], lm.WordTable(head.describe))
    assert (head.contexts.ravel() == np.bincount(near << 3 | far, minlength=head.contexts.size)).all() and head.contexts.sum() == len(near)


@pytest.mark.parametrize("parts", [1, 3])
def test_whole_contexts_are_counted(spark, parts):
    """Scores are those of a plain loop over whole contexts, rare words among them, within what quantising leaves; rare contexts tell words apart."""
    rng = random.Random(5)
    rare = [f"r{i}" for i in range(36_000)]  # more words than have classes of their own
    often = [f"o{int(i)}" for i in range(40) for _ in range(40 - i)]
    texts = [" ".join(w if rng.random() < 0.7 else f"{w} {rng.choice(often)}" for w in rare[k : k + 120] * 3) for k in range(0, 36_000, 120)] + ["z1 z2 y1", "z3 z4 y2"]
    asked = [*texts[:40], "z1 z2 y1", "z1 z2 y2", "z3 z4 y1", "z9 z2 y1 o1 o2", "o1 z2 o3 o4 o5", "", "new"]
    model = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts))
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    head = model[1]
    names = sorted({w for t in [*texts, *asked] for w in t.encode().split()})
    code = dict(zip(names, (int(c) for c in head.codes(lm.hashes(names)[0]))))

    def grams(text):
        """word, classes near and far, whole contexts of one and two."""
        words = [None, None, *text.encode().split(), lm.END]
        for x, a, w in zip(words, words[1:], words[2:]):
            near = lm.BEGIN if a is None else code[a]
            far = lm.FAR + 2 if a is None or x is None else min(code[x], lm.FAR + 1)
            yield w, near, far, a, x

    c1, c2, c3, t2, t3, b2, b3, d2, d3 = (collections.Counter() for _ in range(9))
    for t in texts:
        for w, near, far, a, x in grams(t):
            for c, key in ((c1, w), (c2, (near, w)), (c3, (near, far, w)), (t2, (a, w)), (t3, (x, a, w)), (b2, near), (b3, (near, far)), (d2, a), (d3, (x, a))):
                c[key] += 1
    assert len(c1) > lm.HEAD + 500 and code[b"z1"] == code[b"z2"] == code[b"y1"] == 0 < sum(c > 0 for c in code.values())

    def plain(text):
        total = 0.0
        for w, near, far, a, x in grams(text):
            p = float(head.first(np.array([c1[w]]))[0])
            p = (c2[near, w] + lm.M2 * p) / (b2[near] + lm.M2)
            p = (c3[near, far, w] + lm.M3 * p) / (b3[near, far] + lm.M3)
            if a is not None:
                one = 0 if code[a] else lm.ONE
                p = (lm.TWO * t3[x, a, w] + one * t2[a, w] + lm.M4 * p) / (lm.TWO * d3[x, a] + one * d2[a] + lm.M4)
            total += math.log10(p)
        return total

    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(plain(t), rel=0.02), t
    assert got[40] > got[41] + 0.3 and got[40] > got[42] + 0.3
