"""Near-duplicate classes by ProbMinHash over weighted shingles, banding, and exact verification.

A text's shingles are its runs of ``WORDS`` lower-cased words (a shorter text is one shingle), weighted 1 + ln(count).
Each shingle sends exponential arrivals at the rate of its weight to random registers; a register keeps
its first arrival, and a shingle stops as soon as its next arrival would come after the latest of
all registers. Two texts agree in a register with their probability Jaccard similarity, which for equal weights
is the plain Jaccard. Bands of registers give buckets; what meets in a bucket is verified on the
whole texts, by the exact probability Jaccard of the same weights.

Work by group size. Equal texts are one node. In a bucket ``LEADERS`` nodes lead, and of all the leaders it meets each node is
verified against one: of those surely similar by estimate the first in an order of all nodes, else the most similar. So a group
sends one pair a node, whatever its size, and most of it becomes one component. Then nodes of *different* components that share a
bucket meet more leaders, and of two components the most similar pair so met is verified. What still lies apart is compared whole, node by node. No partner and
no bucket is capped. Estimates are made inside the joins from registers of their own (``MARKS``, of the nodes that share a bucket at all); pairs that are three
standard errors below the threshold go no further. Texts are fetched once, by their digests.

Result: each doc_id once, with class_id, the least doc_id of its class. Null or empty texts are equal texts. Rows that share a
doc_id are one document, and so one class. Rows without doc_id are left out. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import WordTable, arrow, id_and_text, mix, out, pieces, stored, table, windows, word_hashes
from trailmill.llm.components import components
from trailmill.operators.ordering import free

WORDS, SIMILAR = 5, 0.8
#: 32 bands of 8 registers: of pairs at 0.8, 997 of 1000 share a band; links within a class make up for the rest.
BANDS, ROWS = 32, 8
LEADERS = 3
#: Leaders of a bucket for the components that still lie apart in it; they only spare pairs: what they don't link is compared whole.
MORE_LEADERS = 8
#: Registers, drawn apart from those of the bands, that estimate the similarity of what met: 4 bits of each, in longs;
#: and the standard errors that an estimate may lie below the threshold.
MARKS, PER_LONG, ERRORS = 512, 16, 3.0
#: Estimated similarity from which a pair is surely a link for the choice of a leader (it is verified all the same).
SURE = 0.84


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their weights, from word hashes."""
    keys, n = np.unique(windows(words, min(WORDS, len(words))) if len(words) else np.zeros(0, np.uint64), return_counts=True)
    return keys, 1 + np.log(n)


#: Arrivals drawn at once: in the first step as a multiple of what all registers need on average, then for each shingle.
FIRST_TAKE, NEXT_TAKE = 2.0, 8


def prob_min_hash(keys: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The key that first reaches each of m registers."""
    first, holder = np.full(m, np.inf), np.zeros(m, np.uint64)
    times, base, w, step = np.zeros(len(keys)), keys, weights, 0
    while len(base):
        take = max(1, int(FIRST_TAKE * m * np.log(m) / len(base))) if not step else NEXT_TAKE 
        h = mix(base[:, None] + (np.arange(step, step + take, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
        at = times[:, None] + np.cumsum(-np.log(((h >> np.uint64(12)).astype(np.float64) + 1) / (1 << 52)), 1) / w[:, None]
        register = (h & np.uint64(4095)).astype(np.int64) % m
        last = first.max()
        row, k = np.nonzero(at < last)
        t, r = at[row, k], register[row, k]
        np.minimum.at(first, r, t)
        best = t == first[r]
        holder[r[best]] = base[row[best]]
        alive = at[:, -1] < first.max()
        times, base, w, step = at[alive, -1], base[alive], w[alive], step + take
    return holder


def prob_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard: sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i), by order of the ratios x_j / y_j."""
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    keys = np.union1d(ka, kb)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, ka)], y[np.searchsorted(keys, kb)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    y_below = np.concatenate([[0], np.cumsum(y)])
    x_from = x.sum() - np.concatenate([[0], np.cumsum(x)])
    both = (x > 0) & (y > 0)
    at = np.searchsorted(ratio, ratio[both], "left")
    return float(np.sum(1 / (x_from[at] / x[both] + y_below[at] / y[both])))


def hashed(texts: list[str], words: WordTable) -> list[np.ndarray]:
    split = [t.lower().encode().split() for t in texts]
    (h,) = words.look([w for s in split for w in s])
    return np.split(h, np.cumsum([len(s) for s in split])[:-1]) if split else []


def agreement(a, b) -> Column:
    """Estimated similarity from the packed registers of two nodes: equal 4-bit groups, less those equal by chance."""
    unequal = F.transform(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(0x1111111111111111))))
    return 1 - F.aggregate(unequal, F.lit(0), lambda n, x: n + x) / MARKS * (16 / 15)


def near_enough(least: float) -> float:
    p = least + (1 - least) / 16
    return least - ERRORS * (p * (1 - p) / MARKS) ** 0.5 * 16 / 15


def digest_of(text) -> Column:
    """128 bits that stand for a text, by Spark's own functions, so that texts can be found again by them."""
    return F.unhex(F.substr(F.sha2(text, 256), F.lit(1), F.lit(32)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, its band hashes (none for texts without words)."""
    schema = "doc_id long, digest binary, bands array<long>"

    def run(batches):
        to, words = arrow(schema), WordTable(word_hashes)
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in pieces(batches):
            bands = []
            for h in hashed(b.column("text").to_pylist(), words):
                own = mix(prob_min_hash(*shingles(h), BANDS * ROWS)).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) if len(h) else None
                bands.append([] if own is None else mix(own + salt).view(np.int64))
            yield out(to, b.column("doc_id"), b.column("digest"), pa.array(bands, pa.list_(pa.int64())))

    return id_and_text(docs).where("doc_id IS NOT NULL").withColumn("digest", digest_of(F.col("text"))).mapInArrow(run, schema)


def candidates(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """digest, rep, text, bits (packed registers for estimates): of each of ``nodes`` (digest, rep), once."""
    schema = "digest binary, rep long, text string, bits array<long>"
    wanted = nodes.select(F.col("digest").alias("wanted"), F.col("rep").alias("doc_id"))
    found = id_and_text(docs).join(wanted, "doc_id").withColumn("digest", digest_of(F.col("text"))).where("digest = wanted")

    def run(batches):
        to, words = arrow(schema), WordTable(word_hashes)
        shift = np.arange(0, 64, 64 // PER_LONG, dtype=np.uint64)
        for b in pieces(batches):
            bits = []
            for h in hashed(b.column("text").to_pylist(), words):
                keys, weights = shingles(h)
                held = mix(prob_min_hash(mix(keys ^ np.uint64(MARKS)), weights, MARKS)) & np.uint64(15)
                bits.append(np.bitwise_or.reduce(held.reshape(-1, PER_LONG) << shift, 1).view(np.int64))
            yield out(to, b.column("digest"), b.column("rep"), b.column("text"), pa.array(bits, pa.list_(pa.int64())))

    return found.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("text").alias("text")).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, digest_a, b, digest_b) whose ``texts`` (digest, text) are similar enough."""
    own, other = (texts.select(F.col("digest").alias(f"digest_{k}"), F.col("text").alias(f"text_{k}")) for k in "ab")
    joined = pairs.join(other, "digest_b").join(own, "digest_a").select("a", "b", "text_a", "text_b")
    schema = "a long, b long"

    def run(batches):
        to, words = arrow(schema), WordTable(word_hashes)
        for b in pieces(batches, "text_a", most=500_000):
            keys: dict[str, tuple] = {}
            one, two = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            distinct = list(dict.fromkeys([*one, *two]))
            for t, h in zip(distinct, hashed(distinct, words), strict=True):
                keys[t] = shingles(h)
            good = pa.array([prob_jaccard(*keys[x], *keys[y]) >= least for x, y in zip(one, two, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], schema=to)

    return joined.mapInArrow(run, schema)


def crowded(nodes: DataFrame) -> DataFrame:
    """band, digest of each bucket that holds more than one node."""
    buckets = nodes.select("digest", F.explode("bands").alias("band"))
    return buckets.join(buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band", "left_semi")


def first_links(bucketed: DataFrame, near: float) -> DataFrame:
    """For each node, the one leader of its buckets that it is verified against.

    Of leaders that are surely similar by estimate, the one that comes first in an order of all nodes, so that large groups
    gather at few leaders; else the most similar by estimate.
    """
    node = F.struct("rep", "digest", "bits")
    leaders = bucketed.groupBy("band").agg(*(F.min_by(node, F.xxhash64("digest", F.lit(k))).alias(f"lead{k}") for k in range(LEADERS)))
    met = bucketed.join(leaders, "band")
    rank = lambda digest: F.xxhash64(digest, F.lit(0))
    offers = []
    for k in range(LEADERS):
        lead, like = F.col(f"lead{k}"), F.col(f"like{k}")
        met = met.withColumn(f"like{k}", agreement(F.col("bits"), lead["bits"]))
        sure = (like >= SURE) & (rank(lead["digest"]) < rank(F.col("digest")))
        offer = F.struct((~sure).alias("unsure"), F.when(sure, rank(lead["digest"]).cast("double")).otherwise(-like).alias("order"), lead["rep"].alias("rep"), lead["digest"].alias("digest"))
        offers.append(F.when((like >= near) & (lead["digest"] != F.col("digest")), offer))
    best = met.select("rep", "digest", F.least(*offers).alias("offer")).where("offer IS NOT NULL").groupBy("rep", "digest").agg(F.min("offer").alias("offer"))
    return best.select(F.col("rep").alias("a"), F.col("digest").alias("digest_a"), F.col("offer.rep").alias("b"), F.col("offer.digest").alias("digest_b"))


def rooted(bucketed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the node's root."""
    rows = bucketed.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    return rows.join(mixed, "band", "left_semi")


def more_links(rest: DataFrame, near: float) -> DataFrame:
    """For two components that meet at a leader, the pair most similar by estimate: a, digest_a, b, digest_b, root_a, root_b."""
    node = F.struct("rep", "digest", "bits", "root")
    leaders = rest.groupBy("band").agg(*(F.min_by(node, F.xxhash64("digest", F.lit(LEADERS + k))).alias(f"lead{k}") for k in range(MORE_LEADERS)))
    offer = lambda lead: F.when((lead["root"] != F.col("root")) & (agreement(F.col("bits"), lead["bits"]) >= near), F.struct(agreement(F.col("bits"), lead["bits"]).alias("like"), lead["rep"].alias("b"), lead["digest"].alias("digest_b"), lead["root"].alias("root_b")))
    offers = F.array_compact(F.array(*(offer(F.col(f"lead{k}")) for k in range(MORE_LEADERS))))
    met = rest.join(leaders, "band").select(F.col("rep").alias("a"), F.col("digest").alias("digest_a"), F.col("root").alias("root_a"), F.explode(offers).alias("offer")).select("a", "digest_a", "root_a", "offer.*")
    best = F.max_by(F.struct("a", "digest_a", "b", "digest_b", "root_a", "root_b"), F.struct("like", "digest_a", "digest_b"))
    return met.groupBy(F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high")).agg(best.alias("p")).select("p.*")


def across(rest: DataFrame, near: float) -> DataFrame:
    """Pairs of nodes of different roots in one bucket that are similar by estimate; each once, in the first bucket it shares."""
    other = rest.select(*(F.col(c).alias(f"other_{c}") for c in ("band", "rep", "digest", "root", "bands", "bits")))
    shared = F.array_position(F.zip_with("bands", "other_bands", lambda x, y: x == y), True)
    met = (F.col("band") == F.col("other_band")) & (F.col("root") < F.col("other_root")) & (agreement(F.col("bits"), F.col("other_bits")) >= near) & (F.array_position("bands", F.col("band")) == shared)
    return rest.join(other, met).select(
        F.col("rep").alias("a"), F.col("digest").alias("digest_a"), F.col("other_rep").alias("b"), F.col("other_digest").alias("digest_b"),
        F.col("root").alias("root_a"), F.col("other_root").alias("root_b"), agreement(F.col("bits"), F.col("other_bits")).alias("like"),
    )


def relabelled(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after more links (a, b) between roots; only roots that are linked take part in the search."""
    more = components(links)
    own = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return own.unionByName(more.join(own.select("node"), "node", "left_anti"))


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id."""
    near, pair = near_enough(least), ["a", "digest_a", "b", "digest_b"]
    marked = stored(sketches(docs), "sketches")
    nodes = stored(marked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nodes")
    same = marked.select("doc_id", "digest").join(nodes.select("digest", "rep"), "digest").select("doc_id", "rep")
    several = same.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("other")).where("b < other")  # one document, several texts
    alike = same.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    met = stored(crowded(nodes), "buckets")
    texts = stored(candidates(docs, nodes.join(met.select("digest").distinct(), "digest", "left_semi")), "texts")
    bucketed = stored(met.join(texts.select("digest", "rep", "bits"), "digest"), "buckets")
    tried = stored(first_links(bucketed, near), "pairs")
    links = stored(verified(tried, texts, least).unionByName(alike), "links")
    roots = stored(components(links), "roots")
    # What is left: nodes of different components in one bucket. Of two components first one pair is verified; all others
    # only if that doesn't join them.
    between = lambda links, pairs: links.join(pairs, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    rest = stored(rooted(bucketed, roots), "rest")
    pairs = stored(more_links(rest, near), "pairs")
    roots = stored(relabelled(roots, between(stored(verified(pairs.select(*pair), texts, least), "links"), pairs)), "roots")
    rest = rooted(rest.drop("root"), roots).join(nodes.select("digest", "bands"), "digest")
    done = tried.unionByName(pairs.select(*pair))
    done = done.unionByName(done.select(F.col("b").alias("a"), F.col("digest_b").alias("digest_a"), F.col("a").alias("b"), F.col("digest_a").alias("digest_b")))
    met = stored(across(stored(rest, "rest"), near).join(done, pair, "left_anti"), "met")
    late = stored(verified(met.select(*pair), texts, least), "links")
    roots = relabelled(roots, between(late, met))
    return same.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("class_id"))


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row of each class: of the document whose doc_id is the class id, its first row by text and then by all columns.

    Rows without doc_id stay as they are: nothing says which document they are of, so they are neither compared nor dropped.
    """
    rows = free("_rows", docs.columns)
    kept = classes(docs, least).where("doc_id = class_id").select("doc_id")
    counted = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias(rows)).join(kept, "doc_id")
    own = docs.join(counted, "doc_id")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = F.min_by(every, F.struct(F.coalesce("text", F.lit("")), F.to_json(every)))  # whole rows are compared only where an id has several
    several = own.where(F.col(rows) > 1).groupBy("doc_id").agg(first.alias("row")).select("row.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return own.where(F.col(rows) == 1).select(*columns).unionByName(several).unionByName(docs.where("doc_id IS NULL"))


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
