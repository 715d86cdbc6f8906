"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The pairwise part, the sum over i < j of <v_i, v_j> x_i x_j, is computed in linear time
as half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.llm.common import SPACE_BYTES, crc_mod, map_arrow, table, texts

HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 3, 1
#: The model is fitted on at most so many labelled rows, those with the least hash of their id.
SAMPLE_ROWS = 4096
WORD_FEATURES = 4096
FACTORS = 8
EPOCHS = 20
CACHE_WORDS = 200_000

_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOLS, _MARKS = b"#*$%&|<>=@^_~{}[]/\\", b".,;:!?"
STRUCTURE = 16


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh32_intdigest

        bucket = xxh32_intdigest(word, 7) % WORD_FEATURES
        if len(self) < CACHE_WORDS and len(word) <= 40:
            self[word] = bucket
        return bucket


def structure(data: bytes, words: list, n_chars: int | None) -> list[float]:
    """Shape of a text and its metadata, the length recorded in the table; each about 0 to 10."""
    n, n_words = max(len(data), 1), max(len(words), 1)
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / n
    lines = data.split(b"\n")
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    ascii_ = len(data.translate(None, bytes(range(128, 256))))
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        min(len(data.translate(None, SPACE_BYTES)) / n_words, 40.0) / 4,
        10 * share(_UPPER),
        10 * share(_DIGITS),
        10 * share(_SYMBOLS),
        10 * share(_MARKS),
        10 * share(b"!"),
        10 * (1 - ascii_ / n),
        10 * distinct / n_words,
        10 * pairs / n_words,
        10 * (1 - len(set(lines)) / len(lines)),
        np.log1p(len(lines)),
        np.log1p(len(words) / len(lines)),
        np.log1p(max(n_chars or 0, 0)),
        float(n_chars is None),
    ]


class Features:
    """Sparse features of a text: word buckets with damped, normalised counts, then structure."""

    def __init__(self):
        self.buckets = _Buckets()

    def of(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        words = text.lower().split()
        at = np.fromiter(map(self.buckets.__getitem__, words), dtype=np.int64, count=len(words))
        counts = np.bincount(at, minlength=1)
        ids = np.flatnonzero(counts)
        values = np.log1p(counts[ids])
        values /= max(np.sqrt((values**2).sum()), 1e-9)
        return ids.astype(np.int32), values.astype(np.float32), structure(text.encode(), words, n_chars)


@dataclass
class Machine:
    """Weights and factors of the word features, then of the standardised structure features."""

    bias: float
    weights: np.ndarray  # [WORD_FEATURES + STRUCTURE]
    factors: np.ndarray  # [WORD_FEATURES + STRUCTURE, FACTORS]
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, shape: np.ndarray) -> np.ndarray:
        return np.clip((shape - self.mean) / self.scale, -4, 4)

    def score(self, ids: np.ndarray, values: np.ndarray, shape: list[float]) -> float:
        x = np.concatenate([values, self.standard(np.array(shape))])
        at = np.concatenate([ids, np.arange(WORD_FEATURES, WORD_FEATURES + STRUCTURE)])
        v = self.factors[at] * x[:, None]
        z = self.bias + self.weights[at] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _untrained() -> Machine:
    n = WORD_FEATURES + STRUCTURE
    return Machine(0.0, np.zeros(n), np.zeros((n, FACTORS)), np.zeros(STRUCTURE), np.ones(STRUCTURE))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Machine:
    """Logistic loss by Adam over mini-batches of rows, with weight decay. No rows: every score is 1/2."""
    m = _untrained()
    if not rows:
        return m
    shapes = np.stack([s for _, _, s in rows])
    m.mean, m.scale = shapes.mean(axis=0), np.maximum(shapes.std(axis=0), 1e-3)
    fixed = np.arange(WORD_FEATURES, WORD_FEATURES + STRUCTURE)
    ids = [np.concatenate([i, fixed]) for i, _, _ in rows]
    xs = [np.concatenate([v, m.standard(s)]) for _, v, s in rows]
    rng = np.random.default_rng(seed)
    n = WORD_FEATURES + STRUCTURE
    theta = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.02, (n, FACTORS))], axis=1)
    bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    step, rate, batch = 0, 0.02, 128
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(rows), batch):
            mine = order[b : b + batch]
            at = np.concatenate([ids[i] for i in mine])
            x = np.concatenate([xs[i] for i in mine])
            sizes = np.array([len(ids[i]) for i in mine])
            starts = np.cumsum(sizes) - sizes
            got = theta[at] * x[:, None]  # column 0: linear terms; others: v_i x_i
            sums = np.add.reduceat(got, starts, axis=0)
            squares = np.add.reduceat(got[:, 1:] ** 2, starts, axis=0)
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares.sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[mine]) / len(mine)
            each = np.repeat(error, sizes)
            slope = np.repeat(sums, sizes, axis=0) - got  # d z / d v_i is x_i (sum - v_i x_i)
            slope[:, 0] = 1
            slope *= (each * x)[:, None]
            gradient = np.stack([np.bincount(at, weights=slope[:, c], minlength=n) for c in range(1 + FACTORS)], axis=1)
            gradient += 1e-5 * theta
            step += 1
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
            bias -= rate * error.sum()
    return Machine(bias, theta[:, 0].copy(), theta[:, 1:].copy(), m.mean, m.scale)


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, label): at most ``rows`` labelled ids outside the held-out third."""
    learn = labels.where(crc_mod(F.col("doc_id"), HELD_OUT_MODULUS) != HELD_OUT_REMAINDER)
    known = learn.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return texts(docs, n_chars.cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """Fits the machine on a bounded sample: features are made on the executors, from whole texts."""

    def make():
        features = Features()

        def step(b: pa.RecordBatch) -> dict:
            got = [features.of(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            return {
                "doc_id": b.column(0),
                "label": b.column(3),
                "ids": [i.tobytes() for i, _, _ in got],
                "values": [v.tobytes() for _, v, _ in got],
                "shape": [np.array(s, np.float64).tobytes() for _, _, s in got],
            }

        return step

    sample = F.broadcast(_sample(labels, rows))  # at most ``rows`` rows of two numbers
    chosen = _inputs(docs).join(sample, "doc_id").select("doc_id", "text", "n_chars", F.col("label").cast("int"))
    made = map_arrow(chosen, "doc_id long, label int, ids binary, values binary, shape binary", make)
    # One row an id, however often the table repeats it, so that no more than ``rows`` rows come to the driver.
    once = made.groupBy("doc_id").agg(F.min(F.struct("ids", "values", "shape", "label")).alias("r")).select("doc_id", "r.*")
    got = sorted(once.collect(), key=lambda r: r.doc_id)
    parts = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r["values"], np.float32), np.frombuffer(r.shape, np.float64)) for r in got]
    return fit(parts, np.array([r.label for r in got], dtype=float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Only the text and its recorded length are read. A null text counts as empty and is
    scored by its structure, as is the length where it is null or the table has none; a null id is
    never held out unless its empty text form is.
    Repeated rows score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        features, m = Features(), shared.value

        def step(b: pa.RecordBatch) -> dict:
            scores = [m.score(*features.of(t, n)) for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            return {"doc_id": b.column(0), "held_out": b.column(1), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return step

    held_out = crc_mod(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT_REMAINDER
    rows = _inputs(docs).select("doc_id", held_out, "text", "n_chars")
    return map_arrow(rows, "doc_id long, held_out boolean, score double, predicted int", make)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
