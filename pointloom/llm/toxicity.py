"""Toxicity by a classifier chain.

The categories are kinds of toxic texts, found in the training texts as the main directions
in which their features vary, and toxicity itself, the last. They are predicted one after the
other: the linear model of each reads the words and the probabilities of the categories
before it. It is trained with out-of-fold predictions of those, made by whole chains that have
seen nothing of the fold: not for their choice of features, nor for their kinds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.llm.common import crc_mod, map_arrow, table, texts
from pointloom.plans.lineage import cut

HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 3, 1
#: The models are fitted on at most so many labelled rows, those with the least hash of their id.
SAMPLE_ROWS = 8192
#: Of all hashed words and word beginnings, at most so many are features: those that tell the labels
#: apart best, if by so many standard errors.
FEATURES = 4096
LEAST_ERRORS = 3.5
HASHES = 1 << 21
#: Lengths of the word beginnings that are features.
BEGINNINGS = range(3, 10)
FOLDS = 3
CACHE_WORDS = 200_000

#: Kinds of toxic texts that the chain predicts before toxicity; labels.toxic is the only label.
KINDS = 3
_EDGES = ".,!?;:*#$%&|\"'()[]<>-_"


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, which catch inflected and compound forms."""
    from xxhash import xxh32_intdigest

    bare = word.strip(_EDGES)
    if not bare:
        return ()
    keys = ["w" + bare] + [f"{k}{bare[:k]}" for k in BEGINNINGS if len(bare) > k]
    return tuple(xxh32_intdigest(key, 11) % HASHES for key in keys)


class Reader:
    """The distinct features of a text: which of ``columns`` (hash -> column; all hashes if None) it has.

    A beginning that several distinct words share is a second feature, with the hash moved by HASHES.
    """

    def __init__(self, columns: dict[int, int] | None = None):
        self.columns = columns
        self.single: set[int] | None = None if columns is None else {h % HASHES for h in columns}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        got = features_of(word)
        if self.single is not None:
            got = tuple(h for h in got if h in self.single)
        if len(self.cache) < CACHE_WORDS and len(word) <= 40:
            self.cache[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        cache, once, again = self.cache, set(), set()
        for word in {w.strip(_EDGES) for w in set(text.lower().split())}:
            got = cache.get(word)
            for h in self._word(word) if got is None else got:
                (again if h in once else once).add(h)
        found = once.union(h + HASHES for h in again)
        if self.columns is not None:
            found = {self.columns[h] for h in found if h in self.columns}
        return np.array(sorted(found), dtype=np.int32)


@dataclass
class Chain:
    """Columns of the features and, for each category, a bias, a weight a column and one an earlier category."""

    columns: dict[int, int]
    biases: np.ndarray
    weights: np.ndarray  # [categories, columns]
    earlier: np.ndarray  # [categories, categories]

    def predict(self, found: np.ndarray) -> list[float]:
        z = self.biases + self.weights[:, found].sum(axis=1)
        p = np.zeros(len(z))
        for k in range(len(z)):
            p[k] = 1 / (1 + np.exp(-np.clip(z[k] + self.earlier[k] @ p, -30, 30)))
        return p.tolist()


def _linear(found: list[np.ndarray], before: np.ndarray, y: np.ndarray, width: int, steps: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression by full-batch Adam with weight decay on binary columns and dense ones."""
    sizes = np.array([len(f) for f in found])
    at = np.concatenate(found) if len(found) else np.zeros(0, np.int32)
    rows = np.repeat(np.arange(len(found)), sizes)
    dense = before.shape[1]
    theta = np.zeros(width + dense + 1)
    theta[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(rows, weights=theta[at], minlength=len(y)) + before @ theta[width:-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(len(y), 1)
        gradient = np.concatenate([np.bincount(at, weights=error[rows], minlength=width), before.T @ error, [error.sum()]])
        gradient[:-1] += 1e-5 * theta[:-1]
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return float(theta[-1]), theta[:width], theta[width:-1]


def kinds_of(found: list[np.ndarray], toxic: np.ndarray, width: int, kinds: int = KINDS) -> np.ndarray:
    """[rows, kinds]: which toxic rows are of which kind, the one whose direction they lie along most.

    The directions are the leading right singular vectors of the toxic rows' features, by
    subspace iteration from a fixed start. Rows without features are of no kind. The kind with the
    most rows comes first.
    """
    out = np.zeros((len(found), kinds), bool)
    mine = np.array([i for i in np.flatnonzero(toxic) if len(found[i])], dtype=np.int64)
    if not len(mine):
        return out
    x = np.zeros((len(mine), width), np.float32)
    for k, i in enumerate(mine):
        x[k, found[i]] = 1 / np.sqrt(len(found[i]))
    directions = np.random.default_rng(0).normal(size=(width, min(kinds, width)))
    for _ in range(30):
        directions = np.linalg.qr(x.T @ (x @ directions))[0]
    # Of the subspace the singular vectors themselves, so that the order in which rows come does not matter.
    y = x @ directions
    turned = y @ np.linalg.eigh(y.T @ y)[1][:, ::-1]
    best = np.abs(turned).argmax(axis=1)
    order = np.argsort(-np.bincount(best, minlength=kinds), kind="stable")
    out[mine, np.argsort(order)[best]] = True
    return out


def fit(found: list[np.ndarray], toxic: np.ndarray, folds: np.ndarray, columns: Callable[[tuple[int, ...]], dict[int, int]], kinds: Callable = kinds_of) -> Chain:
    """Fits the chain of the kinds and toxicity to rows with features ``found`` (hashes).

    ``columns`` gives the features chosen by the labels of some folds; it and ``kinds`` are asked
    anew for every chain that makes out-of-fold predictions. A chain of one fold has none
    to learn from: its models read the words alone.
    """
    known: dict[tuple[int, ...], Chain] = {}

    def chain(some: tuple[int, ...]) -> Chain:
        if some in known:
            return known[some]
        places = columns(some)
        width, rows = max(len(places), 1), np.flatnonzero(np.isin(folds, some))
        own = [np.array(sorted(places[h] for h in found[i].tolist() if h in places), np.int32) for i in rows]
        y = np.column_stack([kinds(own, toxic[rows] > 0, width), toxic[rows] > 0]).astype(float)
        k = y.shape[1]
        made = Chain(places, np.full(k, -30.0), np.zeros((k, width)), np.zeros((k, k)))
        if len(rows):
            before = np.zeros((len(rows), 0))
            if len(some) > 1:
                before = np.zeros((len(rows), k - 1))
                for fold in some:
                    out = chain(tuple(f for f in some if f != fold))
                    for r in np.flatnonzero(folds[rows] == fold):
                        at = [out.columns[h] for h in found[rows[r]].tolist() if h in out.columns]
                        before[r] = out.predict(np.array(at, np.int32))[:-1]
            for c in range(k):
                made.biases[c], made.weights[c], weights = _linear(own, before[:, :c], y[:, c], width)
                made.earlier[c, : len(weights)] = weights
        known[some] = made
        return made

    return chain(tuple(range(FOLDS)))


def _subsets() -> list[tuple[int, ...]]:
    """The sets of folds whose chains are fitted, the whole first."""
    return [c for n in range(FOLDS, 0, -1) for c in combinations(range(FOLDS), n)]


def _select(read: DataFrame, n_features: int) -> dict[tuple[int, ...], dict[int, int]]:
    """For each set of folds its columns: the ``n_features`` hashes whose share of toxic rows is furthest, in standard
    errors, from that of all its rows. At most that many for each of the few sets come to the driver."""

    def counted(batches):
        for b in batches:
            hashes = [np.frombuffer(x, np.int32) for x in b.column(0).to_pylist()]
            sizes = [len(h) for h in hashes]
            toxic, folds = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), sizes).astype(np.int64) for i in (1, 2))
            every = np.concatenate(hashes).astype(np.int64) if hashes else np.zeros(0, np.int64)
            seen, at = np.unique(every * FOLDS + folds, return_inverse=True)
            hits = np.bincount(at, weights=toxic, minlength=len(seen)).astype(np.int64)
            columns = [pa.array((seen // FOLDS).astype(np.int32)), pa.array((seen % FOLDS).astype(np.int32)), pa.array(np.bincount(at, minlength=len(seen))), pa.array(hits)]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "fold", "n", "hits"])

    sums = read.select("found", "toxic", "fold").mapInArrow(counted, "hash int, fold int, n long, hits long")
    of_fold = [F.sum(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}{f}") for f in range(FOLDS) for c in ("n", "hits")]
    sums = cut(sums.groupBy("hash").agg(*of_fold).fillna(0))
    totals = {r.fold: (r.n, r.hits) for r in read.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).collect()}
    out = {}
    for some in _subsets():
        rows, toxic = (sum(totals.get(f, (0, 0))[i] for f in some) for i in (0, 1))
        if not 0 < toxic < rows:
            out[some] = {}
            continue
        share = toxic / rows
        n, hits = (sum((F.col(f"{c}{f}") for f in some[1:]), F.col(f"{c}{some[0]}")) for c in ("n", "hits"))
        spread = F.abs(hits - n * share) / F.sqrt(n * share * (1 - share) + 1)
        best = sums.where(spread >= LEAST_ERRORS).orderBy(spread.desc(), "hash").limit(n_features).select("hash")
        out[some] = {h: i for i, h in enumerate(sorted(r.hash for r in best.collect()))}
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, n_features: int = FEATURES) -> Chain:
    """Fits the chain on a bounded sample of labelled rows, from whole texts; features are read on the executors.

    Rows with a null id or a label that is not 0 or 1 are left out; of repeated ids one row counts,
    toxic if any label says so. Null texts are empty. Without rows, or with labels of one
    value, no text has features and the chain knows the base rate alone.
    """
    learn = labels.where(crc_mod(F.col("doc_id"), HELD_OUT_MODULUS) != HELD_OUT_REMAINDER)
    known = learn.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # at most ``rows`` rows of two numbers

    def make():
        reader = Reader()
        return lambda b: {"doc_id": b.column(0), "toxic": b.column(2), "found": [reader.of(t).tobytes() for t in b.column(1).to_pylist()]}

    read = map_arrow(texts(docs).join(sample, "doc_id").select("doc_id", "text", "toxic"), "doc_id long, toxic int, found binary", make)
    # One row an id, however often the table repeats it, so that no more than ``rows`` rows come to the driver.
    read = read.groupBy("doc_id").agg(F.min(F.struct("found", "toxic")).alias("r")).select("doc_id", "r.*")
    read = cut(read.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")))
    columns = _select(read, n_features)
    wanted = read.sparkSession.sparkContext.broadcast(np.array(sorted(set().union(*columns.values())), np.int32))

    def chosen():
        def step(b: pa.RecordBatch) -> dict:
            kept = [np.intersect1d(np.frombuffer(x, np.int32), wanted.value).tobytes() for x in b.column(3).to_pylist()]
            return {"doc_id": b.column(0), "toxic": b.column(1), "fold": b.column(2), "found": kept}

        return step

    got = map_arrow(read.select("doc_id", "toxic", "fold", "found"), "doc_id long, toxic int, fold int, found binary", chosen).collect()
    got = sorted(got, key=lambda r: r.doc_id)
    toxic, folds = np.array([r.toxic for r in got], np.int64), np.array([r.fold for r in got], np.int64)
    return fit([np.frombuffer(r.found, np.int32) for r in got], toxic, folds, columns.__getitem__)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per input row: doc_id, held_out, p_kind_1 and so on, score (of toxic), toxic (score >= 0.5), predicted (the same as 0 or 1).

    A null or empty text has no features and gets the chain's base rates. Null ids and
    repeated rows are scored like any other row; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_kind_{i + 1}" for i in range(len(chain.biases) - 1)]

    def make():
        c = shared.value
        reader = Reader(c.columns)

        def step(b: pa.RecordBatch) -> dict:
            p = np.array([c.predict(reader.of(t)) for t in b.column(2).to_pylist()]).reshape(-1, len(c.biases))
            toxic = p[:, -1] >= 0.5
            of_kind = {n: p[:, i] for i, n in enumerate(names)}
            return {"doc_id": b.column(0), "held_out": b.column(1), "score": p[:, -1], "toxic": toxic, "predicted": toxic.astype(np.int32)} | of_kind

        return step

    held_out = crc_mod(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT_REMAINDER
    rows = texts(docs).select("doc_id", held_out, "text")
    kinds = "".join(f"{n} double, " for n in names)
    return map_arrow(rows, f"doc_id long, held_out boolean, {kinds}score double, toxic boolean, predicted int", make)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
