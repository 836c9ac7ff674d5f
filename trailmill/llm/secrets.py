"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, the other of ordinary words and identifiers. Both are first-order
chains over the characters of keys (letters, digits, + / _ = -), trained on labelled samples: values that
the fixed patterns find, with random strings of common key alphabets, against the other runs of the same
characters in a bounded sample of rows (less those that could be either). In each run of such characters, less what the fixed
patterns cover, the whole, or else the part with the highest sum of log-likelihood ratios, is a `random` span if it has 16 or more
characters, its ratio is high in sum and by character, and it has ``LEAST_DISTINCT`` different characters of two kinds (digits, small and
capital letters); a part that fails is searched inside, at a charge for each character, and what is left of the run on both sides too. So a key is found where / _ - or = join it
to ordinary text or to other keys. Keys of one kind of character (small letters only) are never found.
The fixed patterns' own spans always stay.

Null or empty text: no spans, the digest of the empty list. Every text is scanned whole; ties at one
start are ordered by kind. Repeated rows each give a row. Other columns are ignored (``redact`` carries them).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import arrow, flat, id_and_text, out, pieces, raw, small_batches, table

#: Fixed patterns; letters of `assign` in either case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Runs that may be either: no label for training.
UNSURE = re.compile(rb"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "random")
#: Most rows that the models are trained on.
SAMPLE = 4000
#: Weight, in pairs, of a character's own frequency in its transitions.
BACKED = 5.0
LEAST_RUN, LEAST_RATIO, LEAST_MEAN, LEAST_DISTINCT = 16, 40.0, 2.2, 8
#: The mean ratio by character that a part of a run needs, being the best of many, and a run that hasn't both a digit and a letter:
#: names in mixed case and paths stay below 3.2, 19 in 20 random keys of 20 characters and more lie above 4.
CLEAR_MEAN = 3.6

ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
CODE = np.zeros(256, np.uint8)  # 0: outside of the alphabet
CODE[list(ALPHABET)] = np.arange(1, SIZE)
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True


def runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True, of at least so many."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def base_spans(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes; ``hexes``: runs of hex digits in this text."""
    spans = [(a, 2, b) for a, b in hexes]
    if b"AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(spans)


def by_text(found: list[tuple[int, int]], starts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Runs in the joined bytes, by text, with positions in the text."""
    own: dict[int, list[tuple[int, int]]] = {}
    for (a, b), i in zip(found, (np.searchsorted(starts, [a - 1 for a, _ in found], "right") - 1).tolist(), strict=True):
        own.setdefault(i, []).append((a - 1 - int(starts[i]), b - 1 - int(starts[i])))
    return own


def telling(run: bytes, gain: float, whole: bool) -> bool:
    """Whether a run with this sum of log-likelihood ratios is taken for a random string."""
    small, capital, digit = run.upper() != run, run.lower() != run, any(c in b"0123456789" for c in run)
    mean = LEAST_MEAN if whole and digit and (small or capital) else CLEAR_MEAN
    return len(run) >= LEAST_RUN and gain >= LEAST_RATIO and gain >= mean * (len(run) - 1) and len(set(run)) >= LEAST_DISTINCT and small + capital + digit >= 2


#: What a character is charged while the best part of a run is looked for, step by step: at no charge a part may hold several keys and the words between.
CHARGES = (0.0, 0.6, 1.0, 1.4, 1.8, 2.2, 2.6, 3.0)


def likely(text: bytes, part: tuple[int, int], ratio: np.ndarray) -> list[tuple[int, int]]:
    """The spans within one part of a run that are likelier random strings than ordinary ones.

    The part with the highest sum of ratios less the charge is taken if it is telling; else it is searched again inside, at the next charge; what is left
    on both sides is searched at the same one. A part whose best sum is below what any telling span has at that charge holds none.
    """
    found, left = [], [(*part, 0)]
    code = CODE[np.frombuffer(text, np.uint8, part[1] - part[0], part[0])]
    step = ratio[code[:-1], code[1:]]
    while left:
        a, b, level = left.pop()
        if b - a < LEAST_RUN:
            continue
        own = step[a - part[0] : b - part[0] - 1]
        gain = np.concatenate([[0.0], np.cumsum(own)])
        if (a, b) == part and level == 0 and telling(text[a:b], gain[-1], True):
            found.append((a, b))
            continue
        charged = gain - CHARGES[level] * np.arange(len(gain))
        rise = charged - np.minimum.accumulate(charged)
        last = int(rise.argmax())
        if rise[last] < (CLEAR_MEAN - CHARGES[level]) * (LEAST_RUN - 1):
            continue
        first = int(charged[: last + 1].argmin())
        if telling(text[a + first : a + last + 1], gain[last] - gain[first], False):
            found.append((a + first, a + last + 1))
        elif level + 1 < len(CHARGES):
            left.append((a + first, a + last + 1, level + 1))
        left += [(a, a + first, level), (a + last + 1, b, level)]
    return found


def outside(part: tuple[int, int], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What is left of a run without the fixed spans, which are sorted."""
    (a, b), left = part, []
    for s, _, e in spans:
        if s < b and e > a:
            left.append((a, s))
            a = e
    return [*left, (a, b)]


def scan(texts: list[bytes], ratio: np.ndarray | None) -> list[list[tuple[int, int, int]]]:
    """All spans of each text as (start, kind, end) in bytes, sorted."""
    data, starts = flat(texts)
    hexes = by_text(runs(HEX[data], 24), starts)
    words = by_text(runs(CODE[data] > 0, LEAST_RUN), starts) if ratio is not None else {}
    got = []
    for i, text in enumerate(texts):
        spans = base_spans(text, hexes.get(i, []))
        more = [(a, 3, b) for run in words.get(i, []) for part in outside(run, spans) for a, b in likely(text, part, ratio)]
        got.append(sorted(spans + more))
    return got


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans, counted in code points."""
    if not spans or text.isascii():
        return spans
    at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(at[a]), k, int(at[b])) for a, k, b in spans]


def transitions(values: list[bytes]) -> np.ndarray:
    code = CODE[np.frombuffer(b" ".join(values), np.uint8)].astype(np.int64)
    pairs = code[:-1] * SIZE + code[1:]
    return np.bincount(pairs[(code[:-1] > 0) & (code[1:] > 0)], minlength=SIZE * SIZE)


def random_strings(n: int = 400, length: int = 40, seed: int = 5) -> list[bytes]:
    """Labelled random strings of each common key alphabet: hex, base 36 and base 64."""
    rng = np.random.default_rng(seed)
    kinds = [b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[:62], ALPHABET[:64]]
    return [bytes(rng.choice(list(k), length).tolist()) for k in kinds for _ in range(n)]


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """ratio[a, b]: log P(b | a) as a random string less that as an ordinary one. Counted in tasks, summed in Spark."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = "label int, pair int, n long"

    def run(batches):
        to, counts = arrow(schema), np.zeros((2, SIZE * SIZE), np.int64)
        for b in pieces(batches):
            for text, spans in zip(texts := raw(b), scan(texts, None), strict=True):
                counts[1] += transitions([text[a:e] if k else re.split(rb"[:=\"'\x20]+", text[a:e])[-1] for a, k, e in spans])
                left = bytearray(text)
                for a, _, e in spans:
                    left[a:e] = b" " * (e - a)
                counts[0] += transitions([UNSURE.sub(b" ", bytes(left))])
        label, pair = np.nonzero(counts)
        yield out(to, label.astype(np.int32), pair.astype(np.int32), counts[label, pair])

    rows = id_and_text(docs).join(F.broadcast(ids), "doc_id").mapInArrow(run, schema).groupBy("label", "pair").agg(F.sum("n").alias("n")).toPandas()  # 2 x 67^2 rows at most
    counts = np.zeros((2, SIZE, SIZE))
    counts[1] += transitions(random_strings()).reshape(SIZE, SIZE)
    for label, pair, n in rows.itertuples(index=False):
        counts[label, pair // SIZE, pair % SIZE] += n
    plain = counts.sum(1, keepdims=True) + 0.5  # of a character, whatever stands before it: what unseen pairs are taken from
    backed = counts + BACKED * plain / plain.sum(2, keepdims=True)
    log = np.log(backed / backed.sum(2, keepdims=True))
    return (log[1] - log[0]).astype(np.float64)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, counts by kind, digest of the fixed patterns' spans, all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

    def run(batches):
        to = arrow(schema)
        for b in pieces(batches):
            texts = raw(b)
            found = [code_points(t, s) for t, s in zip(texts, scan(texts, ratio), strict=True)]
            yield out(to, b.column("doc_id"), *([sum(x[1] == k for x in s) for s in found] for k in range(4)), [hashlib.sha256(shown([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found], [shown(s) for s in found])

    return id_and_text(docs).mapInArrow(run, schema)


def redact(docs: DataFrame, ratio: np.ndarray, mark: bytes = b"[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans by one. n_chars, where there is one, follows the text."""

    def run(batches):
        for b in pieces(batches):
            texts = [t or b"" for t in raw(b)]
            done = []
            for text, spans in zip(texts, scan(texts, ratio), strict=True):
                made, at = [], 0
                for a, _, e in spans:
                    if a >= at:
                        made += [text[at:a], mark]
                    at = max(at, e)
                done.append((b"".join(made) + text[at:]).decode())
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)} | {"text": pa.array(done, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in done], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return small_batches(docs).mapInArrow(run, docs.schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
