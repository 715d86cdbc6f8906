"""LM scoring with a hashed maximum-entropy model over exact corpus counts.

Frequent tokens are units of their own; all others share units by a hash of their last letters.
The model predicts a token's unit by a class-factored softmax: its class from features of the
unit before (bigram), of the class of the unit before that (skip) and of both together, then the
unit within the class from the unit before, then the token within the unit by its counts. Classes
are learnt from which units follow each other; the weights are trained by distributed gradient
steps on counts of the whole training corpus, so nothing depends on how rows are split.

Above that stands a feature for every pair of adjacent tokens in the corpus, hashed into a
space that grows with the input. Its weight follows from the pair's training count n and that of
the token before, N: the model's probability q becomes (n + k q) / (N + k), which is q times
the exponential of the weight over its normaliser (N + k) / k.

Texts are packed into blocks, which are written once. A block asks for the counts of its
distinct tokens and pairs; what is shuffled are hashes and counts, and each text once.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.common import LOWER, UPPER, crc_mod, texts
from pointloom.plans.lineage import stored

HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 7, 2
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 24
#: Hashes are dealt out by their first bits into a number of ranges that follows the input, so that a range's share stays level.
RANGES_PER_SPLIT, LEAST_RANGES = 4, 16
#: Bits of a pair's hash below those that choose its range.
PAIR_BITS = 32

#: The most frequent tokens have units of their own; the others share one by a hash of their last bytes.
OWN_UNITS = 1024
SUFFIX_BITS, SUFFIX_BYTES = 10, 3
UNITS = OWN_UNITS + (1 << SUFFIX_BITS)
CLASSES = 32
#: Rows of units are summed and trained in so many parts.
PARTS = 64
ROUNDS, STEPS = 4, 30
#: Precision of the Gaussian prior on weights.
PRIOR = 1.0
#: k = STRENGTH * N ** GROWTH: how much a token's followers are left to the model, about as many as are distinct.
STRENGTH, GROWTH = 3.0, 0.8
#: Gradients are summed as integers of this unit, so that no order of the tasks matters.
_UNIT = 2.0**-20

#: No word contains white space, so this stands for the end of a text only.
END = b"\n"
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SLOTS = np.uint64((1 << SUFFIX_BITS) - 1)
_START = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(_LOWER).split(), END]


def key_of(token: bytes) -> int:
    """64 bits that tell tokens apart; the last SUFFIX_BITS of them tell its suffix."""
    from xxhash import xxh3_64_intdigest

    slot = int(_SLOTS)
    return xxh3_64_intdigest(token) & ~slot | xxh3_64_intdigest(token[-SUFFIX_BYTES:]) & slot


@dataclass
class Block:
    """Tokens of some documents in a row: numbers into ``keys``, sorted, and each document's length."""

    ids: np.ndarray
    keys: np.ndarray
    lengths: np.ndarray

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """``values`` of the token before each token, ``start`` before the first of a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[np.cumsum(self.lengths) - self.lengths] = start
        return out


def tokenised(documents: list[bytes]) -> Block:
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, lengths = [], []
    for text in documents:
        words = tokens(text)
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        lengths.append(len(words))
    keys = np.fromiter(map(key_of, numbers), dtype=np.uint64, count=len(numbers))
    ordered, place = np.unique(keys, return_inverse=True)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return Block(place.astype(np.int32)[ids], ordered, np.array(lengths, dtype=np.int64))


def pair_keys(block: Block, range_bits: int) -> np.ndarray:
    """Hash of each token with the one before it, of PAIR_BITS + range_bits bits."""
    keys = block.keys[block.ids]
    with np.errstate(over="ignore"):
        x = (block.before(keys, _START) ^ _START) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x += keys
        x *= np.uint64(0xA0761D6478BD642F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(64 - PAIR_BITS - range_bits)


def _zipped(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzipped(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack(documents: list[tuple[int | None, bool, bytes]]) -> bytes:
    head = struct.pack("<i", len(documents))
    head += b"".join(struct.pack("<?q?q", i is None, i or 0, out, len(t)) for i, out, t in documents)
    return _zipped(head + b"".join(t for _, _, t in documents))


def unpack(payload: bytes) -> list[tuple[int | None, bool, bytes]]:
    data = _unzipped(payload)
    (n,) = struct.unpack_from("<i", data)
    size = struct.calcsize("<?q?q")
    heads = [struct.unpack_from("<?q?q", data, 4 + size * k) for k in range(n)]
    out, at = [], 4 + size * n
    for null, i, held_out, length in heads:
        out.append((None if null else i, held_out, data[at : at + length]))
        at += length
    return out


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, payload): the documents in blocks of about ``block_bytes`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pack(held)])], names=["block", "payload"])
        for batch in batches:
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                if held and size + len(data) > block_bytes:
                    yield row()
                    held, size, number = [], 0, number + 1
                held.append((doc_id, held_out, data))
                size += len(data)
        if held:
            yield row()

    held_out = crc_mod(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT_REMAINDER
    return stored(texts(docs).select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "block long, payload binary"))


def _slice(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between each two ``edges``, without a copy a slice."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _slices(blocks: DataFrame, range_bits: int) -> DataFrame:
    """For each block and range its distinct tokens and pairs by their hashes, in order, with their counts in training texts."""
    schema = "block long, part long, tokens binary, token_counts binary, pairs binary, pair_counts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    every = np.arange((1 << range_bits) + 1, dtype=np.uint64)

    def edges(keys: np.ndarray, below: int) -> np.ndarray:
        inner = np.searchsorted(keys, every[1:-1] << np.uint64(below))
        return np.concatenate([[0], inner, [len(keys)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                documents = unpack(payload)
                block = tokenised([t for _, _, t in documents])
                train = np.repeat(np.array([not out for _, out, _ in documents]), block.lengths)
                counts = np.bincount(block.ids[train], minlength=len(block.keys)).astype("<u4")
                pairs, at = np.unique(pair_keys(block, range_bits), return_inverse=True)
                pair_counts = np.bincount(at[train], minlength=len(pairs)).astype("<u4")
                cuts, pair_cuts = edges(block.keys, 64 - range_bits), edges(pairs, PAIR_BITS)
                rest = (pairs & np.uint64((1 << PAIR_BITS) - 1)).astype("<u4")
                columns = [_slice(block.keys, cuts), _slice(counts, cuts), _slice(rest, pair_cuts), _slice(pair_counts, pair_cuts)]
                n = len(every) - 1
                made = pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n)), *columns], names=names)
                yield made.filter(pa.array((np.diff(cuts) > 0) | (np.diff(pair_cuts) > 0)))

    return blocks.mapInArrow(run, schema)


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a column of bytes end to end, and where each ends."""
    arrays = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(arrays), np.cumsum([len(x) for x in arrays])


def _counted(slices: DataFrame, own: int) -> DataFrame:
    """(block, part, totals, pairs): the training counts over the whole corpus of each slice's tokens and pairs.

    One row of a range, with a null block, holds the tokens and types of each suffix, and its
    most frequent tokens. A range gets a row a block, of which the share of one range is
    as long however many blocks there are.
    """

    def total(group: pa.Table) -> pa.Table:
        part, blocks = group.column("part")[0].as_py(), group.column("block").to_pylist()
        keys, ends = _joined(group.column("tokens"), "<u8")
        counts, _ = _joined(group.column("token_counts"), "<u4")
        distinct, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, weights=counts, minlength=len(distinct)).astype("<i8")  # exact up to 2 ** 53
        answers = [x.tobytes() for x in np.split(sums[place], ends[:-1])]
        slots, at = np.unique((distinct & _SLOTS).astype(np.int64), return_inverse=True)
        stats = np.stack([slots, np.bincount(at, weights=sums, minlength=len(slots)).astype(np.int64), np.bincount(at, weights=sums > 0, minlength=len(slots)).astype(np.int64)])
        first = np.lexsort((distinct, -sums))[:own]
        first = first[sums[first] > 0]
        top = np.stack([distinct[first].view(np.int64), sums[first]]) if len(first) else np.zeros((2, 0), np.int64)
        pairs, ends = _joined(group.column("pairs"), "<u4")
        pair_counts, _ = _joined(group.column("pair_counts"), "<u4")
        known, place = np.unique(pairs, return_inverse=True)
        totals = np.bincount(place, weights=pair_counts, minlength=len(known)).astype("<f4")
        pair_answers = [x.tobytes() for x in np.split(totals[place], ends[:-1])]
        rows = [[*blocks, None], [part] * (len(blocks) + 1), [*answers, stats.astype("<i8").tobytes()], [*pair_answers, top.astype("<i8").tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["block", "part", "totals", "pairs"])

    return stored(slices.groupBy("part").applyInArrow(total, "block long, part long, totals binary, pairs binary"))


@dataclass
class Units:
    """Which unit a token has, and the training tokens and types of each unit."""

    own: np.ndarray  # keys of the tokens with a unit of their own, sorted
    n: np.ndarray  # [UNITS]
    types: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, keys), max(len(self.own) - 1, 0))
        mine = self.own[at] == keys if len(self.own) else np.zeros(len(keys), bool)
        return np.where(mine, at, OWN_UNITS + (keys & _SLOTS).astype(np.int64)).astype(np.uint16)


def _units(counted: DataFrame, own: int) -> Units:
    """The units by the counts of all ranges; a fixed number of sums and tokens comes to the driver."""

    def spread(column: int, names: list[str]):
        def run(batches):
            for batch in batches:
                for raw in batch.column(column).to_pylist():
                    values = np.frombuffer(raw, "<i8").reshape(len(names), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=names)

        return run

    summed = counted.where("block is null").select("totals", "pairs")
    slots = summed.mapInArrow(spread(0, ["slot", "n", "types"]), "slot long, n long, types long")
    n, types = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64)
    for r in slots.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect():
        n[OWN_UNITS + r.slot], types[OWN_UNITS + r.slot] = r.n, r.types
    top = summed.mapInArrow(spread(1, ["key", "n"]), "key long, n long").orderBy(F.col("n").desc(), "key").limit(own).collect()
    top = sorted((r.key % 2**64, r.n) for r in top)
    for i, (key, of_key) in enumerate(top):
        slot = OWN_UNITS + (key & int(_SLOTS))
        n[i], types[i], n[slot], types[slot] = of_key, 1, n[slot] - of_key, types[slot] - 1
    return Units(np.array([k for k, _ in top], np.uint64), n, types)


def _sequences(blocks: DataFrame, units: Units) -> DataFrame:
    """(units, lengths) of the training documents of each block."""
    shared = blocks.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                mine = [t for _, held_out, t in unpack(payload) if not held_out]
                if mine:
                    block = tokenised(mine)
                    values = [_zipped(shared.value.of(block.keys)[block.ids].astype("<u2").tobytes()), block.lengths.astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["units", "lengths"])

    return stored(blocks.select("payload").mapInArrow(run, "units binary, lengths binary"))


_ROWS = -(-(UNITS + 1) // PARTS)  # rows of units, the start of a text included, in a part


def _summed(sequences: DataFrame, cells: int, make) -> DataFrame:
    """(part, counts): over all training tokens, how often each cell of each unit's row occurs.

    ``make`` gives the cells of a block, as unit before times ``cells`` plus cell. Each task sends its
    sums once, at most a number for every cell, in PARTS parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PARTS * _ROWS * cells, np.int32)
        for batch in batches:
            for raw, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = np.frombuffer(_unzipped(raw), "<u2").astype(np.int32)
                block = Block(units, np.zeros(0, np.uint64), np.frombuffer(lengths, "<i8"))
                at, n = np.unique(make(block, units), return_counts=True)
                sums[at] += n.astype(np.int32)
        for part, x in enumerate(sums.reshape(PARTS, -1)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([_zipped(x.astype("<i8").tobytes())])], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_ROWS * cells, np.int64)
        for raw in group.column("counts").to_pylist():
            total += np.frombuffer(_unzipped(raw), "<i8")
        return pa.table([group.column("part")[:1], pa.array([_zipped(total.tobytes())], pa.binary())], names=["part", "counts"])

    return stored(sequences.mapInArrow(run, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary"))


def learnt_classes(pairs: np.ndarray, rounds: int = 15) -> np.ndarray:
    """[UNITS]: classes of units by which units follow them and which they follow; ``pairs`` is [UNITS, UNITS].

    Units start with the nearest of some spread-out units, in the leading directions of the
    positive pointwise mutual information. Then each moves to the class under which its
    neighbours' classes are likeliest, as long as any moves.
    """
    total = max(pairs.sum(), 1.0)
    p = pairs.astype(np.float64) / total
    left, right = p.sum(axis=1), p.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(p / (left[:, None] * right[None, :]))
    pmi = np.where(np.isfinite(pmi), np.maximum(pmi, 0), 0)
    directions = np.random.default_rng(0).normal(size=(len(pairs), 24))
    for _ in range(8):
        directions = np.linalg.qr(pmi.T @ (pmi @ directions))[0]
    places = pmi @ directions
    places /= np.linalg.norm(places, axis=1, keepdims=True) + 1e-9
    centres = [int(left.argmax())]
    while len(centres) < CLASSES:
        centres.append(int((np.sqrt(left) * (1 - (places @ places[centres].T).max(axis=1))).argmax()))
    classes = (places @ places[centres].T).argmax(axis=1)
    for _ in range(rounds):
        member = np.zeros((len(pairs), CLASSES))
        member[np.arange(len(pairs)), classes] = 1
        after, before = pairs @ member, pairs.T @ member
        follow = member.T @ after + 0.1
        likely = after @ np.log(follow / follow.sum(axis=1, keepdims=True)).T
        likely += before @ np.log(follow / follow.sum(axis=0, keepdims=True))
        moved = likely.argmax(axis=1)
        if (moved == classes).all():
            break
        classes = moved
    return classes


def _normal(z: np.ndarray) -> np.ndarray:
    """Log-softmax along the last axis."""
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def _step(counts: np.ndarray, expected: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The gradient of the log-likelihood with its prior over the curvature, at most 1 either way."""
    return np.clip((counts - expected - PRIOR * weights) / (expected + PRIOR), -1, 1)


def class_weights(counts: np.ndarray, bias: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Log-probabilities of classes, [rows, before, classes], after a unit and the class before it, by ``counts`` of the same shape.

    The skip weights [before, classes] are given; those of the unit and of both together are trained
    by gradient steps.
    """
    unit, both = np.zeros((len(counts), 1, counts.shape[2])), np.zeros(counts.shape)
    n = counts.sum(axis=2, keepdims=True)
    for _ in range(STEPS):
        expected = n * np.exp(_normal(bias + skip + unit + both))
        both += 0.5 * _step(counts, expected, both)
        unit += 0.5 * _step(counts.sum(axis=1, keepdims=True), expected.sum(axis=1, keepdims=True), unit)
    return _normal(bias + skip + unit + both)


def unit_weights(counts: np.ndarray, bias: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log-probabilities of units within their classes, [rows, UNITS], after a unit, trained in the same way; only pairs that occur have a weight."""
    weights = np.zeros(counts.shape)
    order = np.argsort(classes, kind="stable")
    starts = np.searchsorted(classes[order], np.arange(CLASSES))
    filled = np.flatnonzero(np.bincount(classes, minlength=CLASSES))

    def by_class(x: np.ndarray) -> np.ndarray:
        """The sums of the classes, back at their units."""
        sums = np.zeros((len(x), CLASSES))
        sums[:, filled] = np.add.reduceat(x[:, order], starts[filled], axis=1)
        return sums[:, classes]

    n = by_class(counts)
    for _ in range(STEPS):
        e = np.exp(bias + weights)
        expected = n * e / by_class(e)
        weights += np.where(counts > 0, _step(counts, expected, weights), 0)
    e = bias + weights
    return e - np.log(by_class(np.exp(e)))


@dataclass
class Model:
    """Natural log-probabilities by the context of a token, each normalised in its last axis or within a class."""

    units: Units
    classes: np.ndarray  # [UNITS]
    of_class: np.ndarray  # [UNITS + 1, CLASSES + 1, CLASSES]: unit before (the start last), class before it, class
    of_unit: np.ndarray  # [UNITS + 1, UNITS]: unit before, unit within its class
    train_tokens: int
    distinct: int


def _biases(units: Units, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of the classes, and of the units within them, with one token added to each unit that tokens can have."""
    share = units.n + 1.0
    share[len(units.own) : OWN_UNITS] = 1e-12
    of_class = np.bincount(classes, weights=share, minlength=CLASSES)
    return np.log(np.maximum(of_class, 1e-3) / share.sum()), np.log(share / of_class[classes])


def _class_cells(block: Block, units: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit before, class of the unit before that, and class, of each token."""
    before = block.before(units, UNITS)
    second = block.before(np.append(classes, CLASSES).astype(np.int32)[before], CLASSES)
    return before, second, classes.astype(np.int32)[units]


def _train(sequences: DataFrame, units: Units) -> Model:
    """Learns classes and trains the weights; tables of fixed size come to the driver.

    Every round, tasks train the weights of their share of the units with the skip weights
    as they are, and send the gradient of those, which all share.
    """
    spark = sequences.sparkSession
    pairs = _summed(sequences, UNITS, lambda block, u: block.before(u, UNITS).astype(np.int64) * UNITS + u)
    follow = np.zeros((PARTS * _ROWS, UNITS))
    for r in pairs.collect():
        follow[r.part * _ROWS : (r.part + 1) * _ROWS] = np.frombuffer(_unzipped(r.counts), "<i8").reshape(_ROWS, UNITS)
    classes = learnt_classes(follow[:UNITS])
    del follow
    bias, unit_bias = _biases(units, classes)
    width = (CLASSES + 1) * CLASSES

    def triples(block: Block, u: np.ndarray) -> np.ndarray:
        before, second, own = _class_cells(block, u, classes)
        return before.astype(np.int64) * width + second * CLASSES + own

    table = _summed(sequences, width, triples)
    skip = np.zeros((CLASSES + 1, CLASSES))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(skip)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, CLASSES + 1, CLASSES), np.int64)
            for batch in batches:
                for raw in batch.column(1).to_pylist():
                    counts = np.frombuffer(_unzipped(raw), "<i8").reshape(_ROWS, CLASSES + 1, CLASSES).astype(float)
                    expected = counts.sum(axis=2, keepdims=True) * np.exp(class_weights(counts, bias, shared.value))
                    sums += np.rint(np.stack([counts - expected, expected]) / _UNIT).astype(np.int64).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        total = np.zeros((2, CLASSES + 1, CLASSES))
        for r in table.mapInArrow(gradient, "sums binary").collect():
            total += np.frombuffer(r.sums, np.int64).reshape(total.shape)
        error, expected = total * _UNIT
        skip = skip + 0.5 * _step(error + expected, expected, skip)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, raw_pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(_unzipped(raw), "<i8").reshape(_ROWS, CLASSES + 1, CLASSES).astype(float)
                of_pairs = np.frombuffer(_unzipped(raw_pairs), "<i8").reshape(_ROWS, UNITS).astype(float)
                made = [class_weights(counts, bias, skip), unit_weights(of_pairs, unit_bias, classes)]
                columns = [pa.array([part]), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in made)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "of_class", "of_unit"])

    of_class = np.broadcast_to(_normal(bias + skip), (PARTS * _ROWS, CLASSES + 1, CLASSES)).astype("<f4")
    of_unit = np.broadcast_to(unit_bias, (PARTS * _ROWS, UNITS)).astype("<f4")
    both = table.join(pairs.withColumnRenamed("counts", "pairs"), "part").select("part", "counts", "pairs")
    for r in both.mapInArrow(tables, "part long, of_class binary, of_unit binary").toLocalIterator():  # PARTS rows
        rows = slice(r.part * _ROWS, (r.part + 1) * _ROWS)
        of_class[rows] = np.frombuffer(r.of_class, "<f4").reshape(_ROWS, CLASSES + 1, CLASSES)
        of_unit[rows] = np.frombuffer(r.of_unit, "<f4").reshape(_ROWS, UNITS)
    return Model(units, classes, of_class[: UNITS + 1], of_unit[: UNITS + 1], int(units.n.sum()), int(units.types.sum()))


def log10_tokens(model: Model, block: Block, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each token, by the training ``counts`` of its types and of the ``pairs`` it ends.

    The tokens of documents come one after the other; contexts do not reach across documents.
    """
    of_type = model.units.of(block.keys).astype(np.int32)
    units, of_unit = of_type[block.ids], model.units
    before, second, own = _class_cells(block, units, model.classes)
    shared = np.log(counts + 1.0) - np.log(of_unit.n[of_type] + of_unit.types[of_type] + 1.0)
    within = np.where(of_type < len(of_unit.own), 0.0, shared)
    q = np.exp(model.of_class[before, second, own].astype(np.float64) + model.of_unit[before, units] + within[block.ids])
    ends = counts[np.searchsorted(block.keys, np.uint64(key_of(END)))] if len(block.keys) else 0
    n = block.before(counts[block.ids].astype(np.float64), ends)
    k = np.where(n > 0, STRENGTH * n**GROWTH, 1.0)
    return np.log10((np.where(n > 0, pairs, 0) + k * q) / (n + k))


_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(blocks: DataFrame, counted: DataFrame, model: Model, range_bits: int) -> DataFrame:
    """Scores of every document: a block meets the answers to its slices, which are in the order of its hashes."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        documents = unpack(left.column("payload")[0].as_py())
        block = tokenised([t for _, _, t in documents])
        answers = right.sort_by("part")
        c, _ = _joined(answers.column("totals"), "<i8")
        totals, _ = _joined(answers.column("pairs"), "<f4")
        base = np.log10(c + 1.0) - np.log10(m.train_tokens + m.distinct + 1.0)
        at = np.unique(pair_keys(block, range_bits), return_inverse=True)[1]
        logs = log10_tokens(m, block, c, totals[at])
        starts = np.cumsum(block.lengths) - block.lengths
        columns = [
            [i for i, _, _ in documents],
            [out for _, out, _ in documents],
            block.lengths,
            np.add.reduceat((c > 0).astype(np.int64)[block.ids], starts),
            np.full(len(documents), m.train_tokens),
            np.add.reduceat(base[block.ids], starts),
            np.add.reduceat(logs, starts),
        ]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    answers = counted.where("block is not null")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCHEMA)


def _range_bits(docs: DataFrame) -> int:
    ranges = max(RANGES_PER_SPLIT * docs.rdd.getNumPartitions(), LEAST_RANGES)
    return (ranges - 1).bit_length()


def train(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, the blocks, the answers to their slices and the bits of the ranges; see ``score``."""
    bits = _range_bits(docs)
    blocks = _blocks(docs, block_bytes)
    counted = _counted(_slices(blocks, bits), OWN_UNITS)
    units = _units(counted, OWN_UNITS)
    return _train(_sequences(blocks, units), units), blocks, counted, bits


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id, modulo 7, is 2 are held out: neither counts nor model
    learn from them. A null id counts as the empty text there. A null text is empty and
    has one token, its end. ``base_score`` is the add-one unigram log10 probability by
    the exact training counts; tokens are told apart by 64-bit hashes. ``score`` is the
    model's log10 probability of the whole text. All tokens that were never seen in training
    and share a unit are one further type of it. The scores are a function of the table, however
    it is split. Repeated rows are scored alike; an empty table gives no rows, one without
    training rows is scored by no counts.
    """
    model, blocks, counted, bits = train(docs, block_bytes)
    return _scored(blocks, counted, model, bits)


def op3(docs: DataFrame) -> DataFrame:
    return score(docs)


def words_of(text: str) -> list[str]:
    """The contract's tokens of a text, for tests: words in lower case, without the end."""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans(UPPER, LOWER)))
