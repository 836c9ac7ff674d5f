"""Vector codes by product quantisation, with exact rounds of k-means over metric trees.

Components become integers floor(1024 x); a vector is cut into equal parts, and each part position has a codebook. Rows
are held in blocks; each block keeps one tree for each part, built by the anchors hierarchy: anchors are the points
farthest from the anchors before them and take over what lies nearer to them; anchors are then merged two by two into the smallest balls up
to one root (middle out), and each anchor is divided again in the same way below. A ball keeps a pivot, a radius, and the sum and number
of its points.

A round sends the codebook down each tree. A ball inherits its parent's list of candidate entries and drops each entry that lies
behind the nearest one for every point of the ball; a ball that has one entry left belongs to it wholly and gives
its cached sum and number, and only balls without that go down to their points. Sums are added up in the task, then by a shuffle
of at most (parts x entries) rows a task. The codebook, whose size is fixed by its parameters, is all that passes through the driver.

All arithmetic is on integers (in floating point only where the numbers are small enough to be exact), so ties go to the lower index
and the result depends on nothing but the rows. Vectors that are null or hold null or non-finite components are dropped; a null
vec_id is kept and comes last; repeated rows and ids are rows of their own, ordered by vec_id, then by components. Fewer rows than entries
give fewer entries; an empty table gives no rows. Vectors of differing length, or of one that the parts don't divide, raise
ValueError, as do components whose squared distances don't fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import arrow, out, table
from trailmill.shared import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block; a ball of so many points or fewer is not divided.
BLOCK, LEAF = 2048, 24


# Metric trees


class Tree:
    """Balls of one block's points in one part. Points lie in tree order, so a ball is a range of them.

    lo, hi: the range. left, right: children, or -1. radius: an upper bound. Pivots and sums are rows of integers.
    """

    FIELDS = (("order", "<i4", 1), ("lo", "<i4", 1), ("hi", "<i4", 1), ("left", "<i4", 1), ("right", "<i4", 1), ("radius", "<f8", 1), ("pivot", "<i8", 0), ("total", "<i8", 0), ("points", "<i8", 0))

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    def pack(self) -> bytes:
        """Bytes, with points and pivots as narrow as their values allow."""
        width = "<i2" if np.abs(self.points).max(initial=0) < 1 << 15 else "<i4"
        n, balls, d = len(self.points), len(self.lo), self.points.shape[1]
        head = struct.pack("<IIII", n, balls, d, int(width[-1]))
        return head + b"".join(getattr(self, name).astype(width if name in ("points", "pivot") else kind).tobytes() for name, kind, _ in self.FIELDS)

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        n, balls, d, width = struct.unpack_from("<IIII", data)
        at, got = 16, {}
        for name, kind, flat in cls.FIELDS:
            rows = n if name in ("order", "points") else balls
            kind = f"<i{width}" if name in ("points", "pivot") else kind
            count = rows * (1 if flat else d)
            a = np.frombuffer(data, kind, count, at)
            at += count * np.dtype(kind).itemsize
            got[name] = a if flat else a.reshape(rows, d)
        return cls(**got)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of a to each of b, exact. Floats (and BLAS) where every number stays below 2^53."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    kind = np.float64 if 4 * a.shape[1] * most * most < 1 << 52 else np.int64
    a, b = a.astype(kind), b.astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


class Points:
    """A block's points with their squared norms, for distances from one point to many."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.kind = np.float64 if 4 * points.shape[1] * int(np.abs(points).max(initial=0)) ** 2 < 1 << 52 else np.int64  # exact either way
        self.own = points.astype(self.kind)
        self.norm = np.einsum("ij,ij->i", self.own, self.own)

    def far(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        """Distances of the rows to a pivot of integers."""
        pivot = pivot.astype(self.kind)
        return np.sqrt((self.norm[rows] - 2 * (self.own[rows] @ pivot) + pivot @ pivot).astype(np.float64))


def anchors(points: Points, own: np.ndarray, count: int) -> tuple[list[np.ndarray], list[float]]:
    """The rows and the radius of each of ``count`` anchors, or fewer, over the rows ``own``.

    The next anchor is the point farthest from its anchor. It asks an old anchor only for points farther from it than half the way
    between the two: nearer ones can't change hands.
    """
    owner, pivots = np.zeros(len(own), np.int64), [int(own[0])]
    reach = points.far(own, points.points[own[0]])
    while len(pivots) < count:
        at = int(reach.argmax())
        if reach[at] == 0:  # all points of every anchor are equal
            break
        pivot = points.points[own[at]]
        half = points.far(np.array(pivots), pivot) * (0.5 * (1 - 1e-9))
        asked = np.flatnonzero(reach >= half[owner])
        new = points.far(own[asked], pivot)
        gone = new < reach[asked]
        owner[asked[gone]], reach[asked[gone]] = len(pivots), new[gone]
        pivots.append(int(own[at]))
    by = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[by], np.arange(len(pivots)))
    return np.split(own[by], edges[1:]), np.maximum.reduceat(reach[by], edges).tolist()


def merged(centres: np.ndarray, sizes: list[int], radii: list[float]) -> int | tuple:
    """A binary tree over the anchors, as nested pairs of their numbers: the two whose merged ball is smallest, again and again."""
    centres, radii, n = centres.astype(np.float64), np.array(radii), len(sizes)
    nodes: list = list(range(n))
    cost = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + radii[:, None] + radii
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(cost.argmin()), n)
        nodes[i] = (nodes[i], nodes[j])
        radii[i] = max(cost[i, j] / 2, radii[i], radii[j])
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        cost[j], cost[:, j] = np.inf, np.inf
        own = np.where(np.isinf(cost[i]), np.inf, np.sqrt(((centres - centres[i]) ** 2).sum(1)) + radii + radii[i])
        cost[i], cost[:, i] = own, own
        last = i
    return nodes[last]


def build(block: np.ndarray) -> Tree:
    """The tree of a block's points (n x d integers, n > 0). The agglomeration decides only which balls there are; radii are measured after it."""
    lo, hi, left, right, radius, pivot, leaves, points = [], [], [], [], [], [], [], Points(block)

    def ball(at: int, rows: np.ndarray, a: int = -1, b: int = -1) -> int:
        p = block[rows].sum(0) // len(rows)
        for held, value in zip((lo, hi, left, right, radius, pivot), (at, at + len(rows), a, b, float(points.far(rows, p).max()) * (1 + 1e-12), p), strict=True):
            held.append(value)
        return len(lo) - 1

    def grow(rows: np.ndarray, at: int) -> tuple[int, np.ndarray]:
        """The ball of these rows, whose range begins at ``at``, and the rows in the order that they lie in."""
        parts, radii = anchors(points, rows, int(np.ceil(np.sqrt(len(rows))))) if len(rows) > LEAF else ([], [])
        if len(parts) < 2:
            leaves.append((at, rows))
            return ball(at, rows), rows
        centres = np.add.reduceat(block[np.concatenate(parts)], np.cumsum([0, *map(len, parts[:-1])]), 0) / np.array([len(p) for p in parts])[:, None]
        return place(merged(centres, [len(p) for p in parts], radii), parts, at)

    def place(node: int | tuple, parts: list[np.ndarray], at: int) -> tuple[int, np.ndarray]:
        if isinstance(node, int):
            return grow(parts[node], at)
        a, first = place(node[0], parts, at)
        b, second = place(node[1], parts, at + len(first))
        rows = np.concatenate([first, second])
        return ball(at, rows, a, b), rows

    grow(np.arange(len(block)), 0)
    order = np.zeros(len(block), np.int64)
    for at, rows in leaves:
        order[at : at + len(rows)] = rows
    own = block[order]
    run = np.concatenate([np.zeros((1, block.shape[1]), np.int64), np.cumsum(own, 0)])
    starts, ends = np.array(lo), np.array(hi)
    return Tree(order=order, lo=starts, hi=ends, left=np.array(left), right=np.array(right), radius=np.array(radius), pivot=np.array(pivot), total=run[ends] - run[starts], points=own)


def owners(tree: Tree, book: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Wholly owned balls as (ball, entry), and the points that were looked at one by one with their entries.

    ``mask`` is each ball's list of candidate entries, inherited from its parent and shortened.
    """
    if len(book) == 1:
        return [(len(tree.lo) - 1, 0)], np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = np.sqrt(squares(book, book).astype(np.float64))
    balls, mask = np.array([len(tree.lo) - 1]), np.ones((1, len(book)), bool)  # the root is the last ball made
    whole, rows, own = [], [], []
    while len(balls):
        far = np.where(mask, squares(tree.pivot[balls], book).astype(np.float64), np.inf)
        best = far.argmin(1)
        least = far[np.arange(len(balls)), best]
        behind = far - least[:, None] > 2 * tree.radius[balls][:, None] * apart[best] * (1 + 1e-9) + far * 2.0**-50  # far beyond rounding; inf > inf is false
        mask = mask & ~behind
        one = mask.sum(1) == 1
        whole += zip(balls[one].tolist(), best[one].tolist(), strict=True)
        balls, mask = balls[~one], mask[~one]
        leaf = tree.left[balls] < 0
        if leaf.any():
            size = tree.hi[balls[leaf]] - tree.lo[balls[leaf]]
            at = np.repeat(tree.lo[balls[leaf]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            lists = np.repeat(mask[leaf], size, 0)
            d = squares(tree.points[at], book)
            rows.append(at)
            own.append(np.where(lists, d, np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf).argmin(1))
        balls, mask = balls[~leaf], mask[~leaf]
        balls, mask = np.concatenate([tree.left[balls], tree.right[balls]]), np.concatenate([mask, mask])
    return whole, np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(own) if own else np.zeros(0, np.int64)


def added(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of each entry's points."""
    totals, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    whole, rows, own = owners(tree, book)
    if whole:
        balls, entries = np.array(whole).T
        np.add.at(totals, entries, tree.total[balls])
        np.add.at(counts, entries, (tree.hi - tree.lo)[balls])
    np.add.at(totals, own, tree.points[rows].astype(np.int64))
    np.add.at(counts, own, 1)
    return totals, counts


def codes(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each point, in the block's own order."""
    entry = np.zeros(len(tree.points), np.int64)
    whole, rows, own = owners(tree, book)
    for ball, e in whole:
        entry[tree.lo[ball] : tree.hi[ball]] = e
    entry[rows] = own
    gap = tree.points.astype(np.int64) - book[entry]
    back = np.zeros((2, len(entry)), np.int64)
    back[:, tree.order] = entry, (gap * gap).sum(1)
    return back[0], back[1]


# Blocks


def integers(vectors: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their components as integers."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    values = vectors.flatten().cast(pa.float64())
    holes = np.asarray(values.is_null())
    values = np.asarray(values.fill_null(0.0))
    row = np.repeat(np.arange(len(vectors)), sizes)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
    bad = np.zeros(len(vectors), bool)
    bad[row[holes | ~np.isfinite(values)]] = True
    keep = np.asarray(vectors.is_valid()) & ~bad
    if not keep.any():
        return keep, np.zeros((0, 0), np.int64)
    length = set(sizes[keep].tolist())
    if len(length) > 1 or (d := length.pop()) % parts or not d:
        raise ValueError(f"vectors must be of one length that {parts} parts divide")
    scaled = scaled[keep[row]].reshape(-1, d)
    if 4.0 * d * float(np.abs(scaled).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large: squared distances don't fit 64 bits")
    return keep, scaled.astype(np.int64)


BLOCKS = "ids array<long>, labels array<long>, dims int, trees array<binary>"


def blocks(vectors: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """ids, labels, dims, trees: blocks of kept rows with a tree for each part."""

    def run(batches):
        to, held = arrow(BLOCKS), []

        def made(some: list) -> pa.RecordBatch:
            ids, labels, points = (pa.concat_arrays([x[0] for x in some]), pa.concat_arrays([x[1] for x in some]), np.concatenate([x[2] for x in some]))
            trees = [build(p).pack() for p in np.split(points, parts, 1)]
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return out(to, one(ids).cast(to.field(0).type), one(labels).cast(to.field(1).type), [points.shape[1]], [trees])

        n = 0
        for b in batches:
            keep, points = integers(b.column("embedding"), parts)
            ids, labels = (b.column(c).cast(pa.int64()).filter(pa.array(keep)) for c in ("vec_id", "label"))
            for a in range(0, len(points), block):
                some = slice(a, a + block)
                held.append((ids[some], labels[some], points[some]))
                n += len(held[-1][2])
                if n >= block:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, BLOCKS)


def unpacked(batches, parts: int) -> Iterator[tuple[pa.Array, pa.Array, list[Tree]]]:
    for b in batches:
        for i in range(b.num_rows):
            trees = [Tree.unpack(t) for t in b.column("trees")[i].as_py()]
            yield b.column("ids")[i].values, b.column("labels")[i].values, trees


def first_entries(held: DataFrame, entries: int, parts: int) -> np.ndarray:
    """Vectors of the smallest ids: each task offers its own smallest, so the driver gets ``entries`` rows at most."""
    schema = "vec_id long, v array<long>"

    def run(batches):
        to, best = arrow(schema), []
        for ids, _, trees in unpacked(batches, parts):
            whole = np.empty((len(ids), len(trees) * trees[0].points.shape[1]), np.int64)
            for k, t in enumerate(trees):
                whole[t.order, k * t.points.shape[1] : (k + 1) * t.points.shape[1]] = t.points
            best = sorted([*best, *((i is None, i or 0, tuple(v)) for i, v in zip(ids.to_pylist(), whole.tolist(), strict=True))])[:entries]
        if best:
            yield out(to, [None if none else i for none, i, _ in best], [list(v) for _, _, v in best])

    some = held.mapInArrow(run, schema).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    return np.array([r["v"] for r in some], np.int64)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """The stored blocks, and the codebooks (parts x entries x components) after ``rounds`` rounds; None for an empty table."""
    spark, held = vectors.sparkSession, stored(blocks(vectors, parts), "blocks")
    lengths = [r["dims"] for r in held.select("dims").distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors must be of one length that {parts} parts divide")
    first = first_entries(held, entries, parts)
    if not len(first):
        return held, None
    books, schema = np.stack(np.split(first, parts, 1)), "part int, entry int, n long, total array<long>"
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)  # parts x entries x components: its size is fixed by parameters

        def run(batches, sent=sent):
            books, to = sent.value, arrow(schema)
            totals, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for _, _, trees in unpacked(batches, parts):
                for k, t in enumerate(trees):
                    s, n = added(t, books[k])
                    totals[k] += s
                    counts[k] += n
            k, e = np.nonzero(counts)
            yield out(to, k.astype(np.int32), e.astype(np.int32), counts[k, e], list(totals[k, e]))

        own = held.select("ids", "labels", "trees").mapInArrow(run, schema)
        summed = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(books.shape[2])))
        new = books.copy()
        for r in summed.collect():  # parts x entries rows at most
            new[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(books.shape[2])]
        sent.unpersist()
        books = new
    return held, books


def encode(held: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every kept row."""
    parts, schema = len(books), "vec_id long, label long, code string, error long"
    sent = held.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        to, hex_ = arrow(schema), np.array([f"{i:02x}" for i in range(sent.value.shape[1])])
        for ids, labels, trees in unpacked(batches, parts):
            got = [codes(t, sent.value[k]) for k, t in enumerate(trees)]
            code = hex_[got[0][0]]
            for entry, _ in got[1:]:
                code = np.char.add(code, hex_[entry])
            yield out(to, ids, labels, code.tolist(), sum(e for _, e in got))

    return held.select("ids", "labels", "trees").mapInArrow(run, schema)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


#: Labels up to this number are sent to every task; more are joined by a shuffle.
LABELS_SENT = 50_000


def with_label_errors(coded: DataFrame, labels_sent: int = LABELS_SENT) -> DataFrame:
    """Adds label_error: error summed over rows of equal label, nulls together."""
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    small = totals.limit(labels_sent + 1).count() <= labels_sent
    return coded.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")


RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def op12_veccodes(spark, sf_dir: str) -> DataFrame:
    held, books = train(table(spark, sf_dir, "embeddings"))
    if books is None:
        return spark.createDataFrame([], RESULT)
    coded = with_label_errors(stored(encode(held, books), "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds spelled out: assignments by a join of all parts with all entries, which only small tables bear."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})"""
    ]
    near = "(SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM (SELECT r, cut.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut JOIN b{0} b ON cut.p = b.p) GROUP BY r, p)"
    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED {near.format(k)},
m{k} AS (SELECT p, e, j, sum(CAST(s AS HUGEINT)) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x) AS s, generate_subscripts(x, 1) AS j FROM a{k} a JOIN cut USING (r, p)) GROUP BY p, e, j),
n{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM m{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n USING (p, e))""")
    steps.append(f"""z AS MATERIALIZED {near.format(rounds)},
w AS (SELECT r, string_agg(format('{{:02x}}', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN w USING (r), h""")
    return ",\n".join(steps)


OP12_SQL = _sql()
