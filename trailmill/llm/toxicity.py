"""Toxicity: subword embeddings averaged over a text into a linear softmax, trained jointly in numpy.

A text is the mean of the vectors of its character n-grams (3 to 6 bytes within a word, white space
marking the ends), so a misspelling or a compound never seen before shares most of its vectors with what
was seen. The vectors and the softmax are learned together by AdaGrad on a bounded sample of labelled
rows (``per_class`` of each label, lowest hash first); the sample is trained on in one task, the model
is one table of 2^19 numbers, and every row of the input is scored.

Because the softmax is linear in the mean, a scorer needs only each n-gram's contribution to the
margin: score = sigmoid(bias + mean of contributions) - the same value, one table read per n-gram.

Null or empty text: the mean is 0, so the score is that of the bias. No labels, or labels of one
kind: the score is the share of label 1 (0 without labels). Repeated doc_ids in labels: label 1 if
any says so. Repeated rows each give a row. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import arrow, crc_mod, id_and_text, out, pieces, raw, table
from trailmill.llm.subwords import averages, bag

SIZES, BITS, DIM = range(3, 7), 19, 8
#: Standard errors by which an n-gram must tell the labels apart to get a vector: fewer let n-grams of single texts in, which costs precision on held-out rows.
LEAST_Z = 4.0
#: Rows of a step, and about how many steps a fit takes: between so many passes over the rows. Few rows need more passes, many overfit by them.
BATCH, STEPS, EPOCHS = 64, 2100, (30, 100)
#: Most labelled rows of each label that a model is fitted on.
PER_CLASS = 3000
#: A text is called toxic from this score on.
THRESHOLD = 0.7


def telling(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, least_z: float) -> np.ndarray:
    """Buckets that as many standard errors more texts of one label hold: others only tell single texts apart."""
    n = np.array([np.sum(labels == 0), np.sum(labels == 1)])
    held = [np.bincount(np.concatenate([bags[i][0] for i in np.flatnonzero(labels == k)]), minlength=1 << BITS) for k in (0, 1)]
    both = (held[0] + held[1]) / n.sum()
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    return np.flatnonzero(np.abs(held[1] / n[1] - held[0] / n[0]) >= least_z * error)


def fit(texts: list[bytes], labels: np.ndarray, prior: float, epochs: int | None = None, step: float = 0.4, least_z: float = LEAST_Z, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's contribution to the margin, and the bias. prior: share of label 1 where scores will be made."""
    if len(set(labels.tolist())) < 2:
        p = min(max(float(np.mean(labels)) if len(labels) else 0.0, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    epochs = epochs or min(max(EPOCHS[0], STEPS * BATCH // len(texts)), EPOCHS[1])
    bags = [bag(t, SIZES, BITS) for t in texts]
    common = telling(bags, labels, least_z)
    place = np.full(1 << BITS, -1, np.int64)
    place[common] = np.arange(len(common))
    bags = [(place[b][k], s[k]) for b, s in bags for k in (place[b] >= 0,)]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(common), DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    past = [np.full(x.shape, 1e-10, np.float32) for x in (vectors, soft, bias)]
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for rows in np.array_split(order, max(1, len(order) // BATCH)):
            at = np.concatenate([bags[r][0] for r in rows])
            part = np.concatenate([bags[r][1] for r in rows]).astype(np.float32)
            row = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            mean = np.stack([np.bincount(row, part * vectors[at, k], len(rows)) for k in range(DIM)], 1).astype(np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back = p @ soft.T
            touched, where = np.unique(at, return_inverse=True)
            g = np.stack([np.bincount(where, part * back[row, k], len(touched)) for k in range(DIM)], 1).astype(np.float32)
            past[0][touched] += g * g
            vectors[touched] -= step * g / np.sqrt(past[0][touched])
            for x, grad, s in ((soft, mean.T @ p, past[1]), (bias, p.sum(0), past[2])):
                s += grad * grad
                x -= step / 4 * grad / np.sqrt(s)
    gain = np.zeros(1 << BITS, np.float32)
    gain[common] = vectors @ (soft[:, 1] - soft[:, 0])
    q = min(max(prior, 1e-4), 1 - 1e-4)
    return gain, float(bias[1] - bias[0] + np.log(q / (1 - q)) - np.log(share[1] / share[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, fit=fit) -> tuple[np.ndarray, float]:
    """Fits on at most ``per_class`` rows of each label; the sample meets in one task, of which only the model comes back."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n, ones = one.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    chosen = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = id_and_text(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 x per_class ids at most, and one row an id before they meet
    prior = ones / n if n else 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        gain, bias = fit([t.encode() for t in pdf["text"]], pdf["label"].to_numpy(), prior)
        return pd.DataFrame({"gain": [gain.astype("<f4").tobytes()], "bias": [bias]})

    got = sample.withColumn("together", F.lit(0)).groupBy("together").applyInPandas(run, "gain binary, bias double").first()
    if got is None:
        return np.zeros(1 << BITS, np.float32), float(np.log(1e-6))
    return np.frombuffer(got["gain"], "<f4"), got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every text."""
    schema = "doc_id long, score double"
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2^19 floats, whatever the input

    def run(batches):
        to, (gain, bias) = arrow(schema), shipped.value
        for b in pieces(batches):
            z = np.clip(averages(raw(b), gain, SIZES, BITS) + bias, -500, 500)
            yield out(to, b.column("doc_id"), 1 / (1 + np.exp(-z)))

    return id_and_text(docs).mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    scored = score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
