"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

View 1, content: case-sensitive byte 2- and 3-grams within words, hashed to 2^11 shares. View 2, metadata: source, language
and declared length, and the page's layout (number and length of lines and words, shares of letters in either case, digits, marks and
blanks). Each view has a logistic regression. In each round both views give margins to *every* document without a
label; the ``PER_ROUND`` rows of each label that a view is surest of join the other view's training rows. Then each view is
calibrated on labelled rows that neither was trained on, and a logistic regression on both calibrated margins
gives the score of every row.

Only the labelled rows are a bounded sample (``LABELLED``, lowest hash of the id first), reduced to one row an id before they meet in the
one task that fits; the pool is all documents without label, and of it ``4 * PER_ROUND`` rows a round reach that task.
A score depends on its own row only. Null text: empty. Null source, lang or n_chars: a value of its own. Repeated doc_ids: the fit takes
the first row by text, every row is scored. Ties in margin: the lower doc_id. Rows without doc_id are scored, not learned from. Without
labels of both kinds every row gets the share of label 1 (1 without labels), so nothing is rejected. Empty tables give no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import arrow, flat, out, pieces, raw, stored, table
from trailmill.llm.subwords import grams

#: Most labelled rows that the two views are fitted on.
LABELLED = 3000
BITS, SIZES = 11, range(2, 4)
ROUNDS, PER_ROUND = 2, 150
#: A view is sure of a row from this margin on, about 19 in 20.
SURE = 3.0
#: Steps of a first fit, and of one that goes on from the round before.
STEPS, MORE_STEPS = 200, 60
#: Rows with a score below this are rejected.
KEEP_FROM = 0.5

KIND = np.zeros((256, 7), np.float32)
for _i in range(256):
    KIND[_i] = [65 <= _i < 91, 97 <= _i < 123, 48 <= _i < 58, _i in (10, 13), _i in (9, 11, 12, 32), _i >= 128, 32 < _i < 48 or 57 < _i < 65 or 90 < _i < 97 or 122 < _i < 127]


def content(texts: list[bytes]) -> np.ndarray:
    """Shares of hashed n-grams, a row for each text; an n-gram counts for the text that it begins in, and never reaches into the next."""
    data, starts = flat(texts)
    got = np.zeros((len(texts), 1 << BITS), np.float32)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    for bucket, counts in grams(data, SIZES, BITS):
        here = np.flatnonzero(counts[: len(row)])
        got += np.bincount((row[here] << BITS) + bucket[here], minlength=got.size).reshape(got.shape).astype(np.float32)
    return np.sqrt(got / np.maximum(got.sum(1, keepdims=True), 1))


#: Cells that the values of source and of lang are hashed to.
SOURCES, LANGS = 256, 64


def metadata(texts: list[bytes], source: list, lang: list, n_chars: list) -> np.ndarray:
    """Layout of the page, declared length, and a cell each for source and language."""
    data, starts = flat(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    counts = np.bincount(row * 256 + data[: len(row)], minlength=256 * len(texts)).reshape(-1, 256).astype(np.float32)
    kinds = counts @ KIND
    size = np.maximum(kinds.sum(1), 1)
    lines, blanks = kinds[:, 3] + 1, kinds[:, 4] + kinds[:, 3] + 1
    shape = np.column_stack([np.sqrt(kinds / size[:, None]), np.log1p(size), np.log1p([c or 0 for c in n_chars]), [c is None for c in n_chars], np.log1p(lines), np.log1p(size / lines), np.log1p(size / blanks), (counts > 0).sum(1) / 64])
    hot = np.zeros((len(texts), SOURCES + LANGS), np.float32)
    for i, (s, k) in enumerate(zip(source, lang, strict=True)):
        hot[i, xxhash.xxh3_64_intdigest(str(s)) % SOURCES] = 0.3
        hot[i, SOURCES + xxhash.xxh3_64_intdigest(str(k)) % LANGS] = 0.3
    return np.column_stack([shape, hot]).astype(np.float32)


def both_views(texts: list[bytes], source: list, lang: list, n_chars: list) -> list[np.ndarray]:
    return [content(texts), metadata(texts, source, lang, n_chars)]


class Logistic:
    """Logistic regression on standardised columns, by full-batch Adam with a ridge; ``start``: an earlier fit to go on from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, start: Logistic | None = None, ridge: float = 1e-3, steps: int = STEPS, rate: float = 0.05):
        self.mean, self.scale = (start.mean, start.scale) if start else (x.mean(0), x.std(0) + 0.02)
        self.w, self.b = (start.w, start.b) if start else (np.zeros(x.shape[1], np.float32), 0.0)
        z, m, v, mb, vb = self.shown(x), 0.0, 0.0, 0.0, 0.0
        for t in range(1, steps + 1):
            e = 1 / (1 + np.exp(-np.clip(z @ self.w + self.b, -30, 30))) - y
            g, gb = z.T @ e / len(y) + ridge * self.w, e.mean()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            self.w = (self.w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            self.b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)

    def shown(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", self.shown(x), self.w) + self.b  # row by row, so that a row's margin doesn't depend on its neighbours


def held_out(ids: list[int]) -> np.ndarray:
    """A third of the labelled rows, by hash of the id: for calibration only."""
    return np.array([xxhash.xxh3_64_intdigest(str(i)) % 3 == 0 for i in ids], bool)


def learn(views: list[np.ndarray], y: np.ndarray, teaches: list[np.ndarray], start: tuple | None) -> tuple:
    """(view 1, view 2), each on the rows that teach it."""
    models = []
    for k, view in enumerate(views):
        own = teaches[k]
        models.append(Logistic(view[own], y[own], start[k] if start else None, steps=MORE_STEPS if start else STEPS))
    return tuple(models)


def calibrate(models: tuple, views: list[np.ndarray], y: np.ndarray) -> tuple:
    """The two views, a calibration of each, and their combination."""
    margins = [m.margin(v)[:, None] for m, v in zip(models, views, strict=True)]
    fits = [Logistic(m, y) for m in margins]
    both = np.column_stack([f.margin(m) for f, m in zip(fits, margins, strict=True)])
    return *models, *fits, Logistic(both, y)


def combined(model: tuple, views: list[np.ndarray]) -> np.ndarray:
    m1, m2, c1, c2, last = model
    both = np.column_stack([c.margin(m.margin(v)[:, None]) for m, c, v in zip((m1, m2), (c1, c2), views, strict=True)])
    return 1 / (1 + np.exp(-np.clip(last.margin(both), -30, 30)))


META = ("source", "lang", "n_chars")


def page_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def read_views(b: pa.RecordBatch) -> list[list[np.ndarray]]:
    """Both views of the rows of a batch, 512 at a time."""
    texts = [t or b"" for t in raw(b)]
    return [both_views(texts[a : a + 512], *(b.column(b.schema.get_field_index(c)).slice(a, 512).to_pylist() for c in META)) for a in range(0, len(texts), 512)]


def margins(docs: DataFrame, models: tuple) -> DataFrame:
    """doc_id and the margin of each view, of every row."""
    shipped, schema = docs.sparkSession.sparkContext.broadcast(models), "doc_id long, m0 double, m1 double"  # 2 x (2^11 + 340) numbers

    def run(batches):
        to, own = arrow(schema), shipped.value
        for b in pieces(batches):
            views = read_views(b)
            yield out(to, b.column("doc_id"), *(np.concatenate([m.margin(v[k]).astype(float) for v in views]) for k, m in enumerate(own)))

    return page_rows(docs).where("doc_id IS NOT NULL").mapInArrow(run, schema)


def surest(docs: DataFrame, labels: DataFrame, known: DataFrame, models: tuple, per_round: int) -> DataFrame:
    """doc_id, label, view: the rows without label, and not yet taken, that a view is surest of; ``view`` is the one to be taught."""
    spare = margins(docs, models).join(labels, "doc_id", "left_anti").groupBy("doc_id").agg(F.min("m0").alias("m0"), F.min("m1").alias("m1"))
    spare = stored(spare, "margins")
    found = None
    for k in (0, 1):
        free = spare.join(F.broadcast(known.where(F.col("view") == 1 - k)), "doc_id", "left_anti")
        for label in (0, 1):
            margin = F.col(f"m{k}") if label else -F.col(f"m{k}")
            one = free.where(margin > SURE).orderBy(margin.desc(), "doc_id").limit(per_round).select("doc_id", F.lit(label).alias("label"), F.lit(1 - k).alias("view"))
            found = one if found is None else found.unionByName(one)
    return found


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND):
    """The model, or the share of label 1 where there are not both labels."""
    spark = docs.sparkSession
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).withColumn("view", F.lit(-1))  # -1: a true label, which teaches both
    page = F.struct("text", *META)
    taken, models = spark.createDataFrame([], "doc_id long, label int, view int"), None

    def fit(final: bool):
        chosen = sample.unionByName(taken)
        pages = page_rows(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min(page).alias("page"))  # one row an id, before anything meets
        start = models

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "view"])
            y, view = pdf["label"].to_numpy(np.float32), pdf["view"].to_numpy()
            true = view < 0
            held = held_out(pdf["doc_id"].tolist()) & true
            if any(len(set(y[part].tolist())) < 2 for part in (held, true & ~held)):
                return pd.DataFrame({"model": [pickle.dumps(float(y[true].mean()) if true.any() else 1.0)]})
            made = [both_views([t.encode() for t in p["text"]], [*p["source"]], [*p["lang"]], [None if c != c else c for c in p["n_chars"]]) for p in (pdf.iloc[a : a + 256] for a in range(0, len(pdf), 256))]
            views = [np.concatenate([m[k] for m in made]) for k in (0, 1)]
            learned = learn(views, y, [(true & ~held) | (view == k) for k in (0, 1)], start)
            return pd.DataFrame({"model": [pickle.dumps(calibrate(learned, [v[held] for v in views], y[held]) if final else learned)]})

        rows = chosen.join(pages, "doc_id").select("doc_id", "label", "view", "page.*").withColumn("together", F.lit(0))
        got = rows.groupBy("together").applyInPandas(run, "model binary").first()
        return pickle.loads(got["model"]) if got else 1.0

    for _ in range(rounds):
        models = fit(False)
        if isinstance(models, float):
            return models
        more = surest(docs, one, taken, models, per_round).collect()  # 4 x per_round rows at most
        if not more:
            break
        taken = spark.createDataFrame([*taken.collect(), *more], taken.schema)
    return fit(True)


def score(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` in their order, then ``name``. An input column of that name is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2 x (2^11 + 340) numbers, whatever the input
    rows = docs.drop(name)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + (", " if rows.columns else "") + f"`{name}` double"

    def run(batches):
        m = shipped.value
        for b in pieces(batches):
            got = np.full(b.num_rows, m) if isinstance(m, float) else np.concatenate([combined(m, v) for v in read_views(b)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got.astype(float))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, kinds)


def keep_good(docs: DataFrame, model, least: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their own columns, whatever these are called."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).where(F.col(name) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "score", (F.col("score") >= KEEP_FROM).alias("keep"))
