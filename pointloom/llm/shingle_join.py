"""Near-dedup by the exact similarity of word shingles: every pair that reaches it is found.

Multi-index hashing of SimHashes finds the pairs that are a few bits apart. As texts of a
similarity of 0.8 may be 15 bits apart, which no small Hamming ball reaches, the pairs that it
leaves are found by a prefix filter; both only propose pairs, which are compared by whole sets.

Sets of shingles with a Jaccard similarity of t or more share a shingle among the
first n - ceil(t * n) + 1 of each, in any one order of all shingles. The order goes by
a sketch of how often shingles occur, rare ones first, so few texts meet at one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pointloom.llm.common import LOWER, UPPER, map_arrow, release, sliced, texts
from pointloom.llm.simhash import CROWDED, MAX_DISTANCE, SEGMENTS, as_long, hamming_links, simhash
from pointloom.operators.graph import connected_components
from pointloom.plans.lineage import cut, stored
from pointloom.plans.skew import among, lookup_join, without

SHINGLE_WORDS = 5
#: Texts are near-duplicates from a Jaccard similarity of SIMILAR[0] / SIMILAR[1].
SIMILAR = (4, 5)
#: Slots of the sketch of shingle counts, and of the table of shingles that several texts have, as powers of two;
#: both sizes are fixed and change only how many entries are moved, not the result.
SKETCH_BITS = 23
TABLE_BITS = 25
#: How often the nodes of a key, if there are more, are compared with how many of them before what is left apart is
#: compared pair by pair.
STAR_ROUNDS, CENTRES = 2, 8
#: Slots of a set's marks, a power of two, and the columns that hold them.
MARK_BITS = 256
MARKS = tuple(f"m{k}" for k in range(MARK_BITS // 64))

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingles(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles by 64-bit hashes, sorted; one shingle of a shorter text, none without words."""
    from xxhash import xxh3_64_intdigest

    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = text.encode().translate(_LOWER).split()
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    hashes = np.fromiter(map(xxh3_64_intdigest, numbers), dtype=np.uint64, count=len(numbers))[ids]
    width = min(shingle_words, len(words))
    n = len(words) - width + 1 if width else 0
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        with np.errstate(over="ignore"):
            out = (out ^ hashes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def _sketch(rows: DataFrame, shingle_words: int, bits: int) -> np.ndarray:
    """About how many texts (up to 65,535 of a slot) have a shingle, by the first ``bits`` bits of its hash; two bytes a slot come to the driver."""
    import zstandard

    parts, size = 64, 1 << bits

    def packed(x: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(np.minimum(x, 2**16 - 1).astype("<u2").tobytes())

    def unpacked(raw: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u2").astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int32)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                np.add.at(seen, (shingles(text, shingle_words) >> np.uint64(64 - bits)).astype(np.int64), 1)
        if seen.any():
            pieces = [packed(x) for x in seen.reshape(parts, -1)]
            del seen
            release()
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(pieces)], names=["part", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + unpacked(raw)
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed(x)])], names=["part", "seen"])

    schema = "part int, seen binary"
    got = rows.select("text").mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).collect()
    out = np.zeros((parts, size // parts), np.uint16)
    for r in got:
        out[r.part] = unpacked(r.seen)
    return out.ravel()


def _marks(s: np.ndarray) -> np.ndarray:
    """Of each of MARK_BITS slots, whether an odd number of the shingles falls into it, as longs.

    The marks of two sets differ in no more slots than the sets differ in shingles.
    """
    odd = np.bincount((s & np.uint64(MARK_BITS - 1)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(rows: DataFrame, sketch: np.ndarray, shingle_words: int, bits: int) -> DataFrame:
    """(row, doc_id, fp, sim, n, common, prefix): what equal sets share, the SimHash, the number of shingles, how frequent they are,
    the marks of the whole set (see ``_marks``) and the first in the order."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def make():
        import xxhash

        counts = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            fps, sims, sizes, commons, marks, prefixes = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, shingle_words)
                n = len(s)
                seen = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((s, seen))
                first = n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1 if n else 0
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                sims.append(as_long(simhash(text, shingle_words)))
                sizes.append(n)
                commons.append(float(np.log2(seen + 1.0).mean()) if n else 0.0)
                marks.append(_marks(s))
                prefixes.append(s[order[:first]].view(np.int64))
            return {"row": batch.column(0), "doc_id": batch.column(1), "fp": fps, "sim": sims, "n": sizes, "common": commons, "prefix": prefixes} | {m: [x[k] for x in marks] for k, m in enumerate(MARKS)}

        return step

    schema = "row long, doc_id long, fp binary, sim long, n long, common double, prefix array<long>" + "".join(f", {m} long" for m in MARKS)
    return map_arrow(rows.select("row", "doc_id", "text"), schema, make)


def _enough(overlap: Column) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles with so many in common are similar."""
    return overlap * (SIMILAR[0] + SIMILAR[1]) >= (F.col("na") + F.col("nb")) * SIMILAR[0]


def _may_reach(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether the sets of two entries, given by their columns, can be similar if they meet at the first shingle they share, and by their marks."""
    n, rest = a("n") + b("n"), F.least(a("n") - a("i"), b("n") - b("i"))
    differ = sum((F.bit_count(a(m).bitwiseXOR(b(m))) for m in MARKS), F.lit(0))
    return (rest * (SIMILAR[0] + SIMILAR[1]) >= n * SIMILAR[0]) & (differ * (SIMILAR[0] + SIMILAR[1]) <= n * (SIMILAR[1] - SIMILAR[0]))


def _similar(rows: DataFrame, pairs: DataFrame, shingle_words: int) -> DataFrame:
    """The pairs whose whole sets are similar. Only texts in pairs are read into sets and shuffled."""
    ends = cut(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct())

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {"row": batch.column(0), "s": [shingles(t, shingle_words).view(np.int64) for t in batch.column(1).to_pylist()]}

        return step

    sets = stored(map_arrow(among(rows.select("row", "text"), ends, "row"), "row long, s array<long>", make, slice_rows=64))
    left, right = (sets.select(F.col("row").alias(x), F.col("s").alias(f"s{x}"), F.size("s").cast("long").alias(f"n{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").where(_enough(F.size(F.array_intersect("sa", "sb")))).select("a", "b")


def _hamming_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose SimHashes are equal or within MAX_DISTANCE bits, found by multi-index hashing."""
    heads = cut(nodes.groupBy(F.col("sim").alias("fp")).agg(F.min("row").alias("head"), F.count("*").alias("n")))
    near = hamming_links(heads.select("fp"), MAX_DISTANCE, SEGMENTS, CROWDED)
    a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
    across = near.join(a, "a").join(b, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    same = lookup_join(nodes.select("row", F.col("sim").alias("fp")), heads.where("n > 1"), "fp", "n", nodes.count(), how="inner", nulls=False)
    return across.unionByName(same.where("head < row").select(F.col("head").alias("a"), F.col("row").alias("b")))


def _repeated_entries(nodes: DataFrame, table_bits: int) -> DataFrame:
    """(row, n, common, marks, i, key): prefix entries of keys that several nodes have, and few of the others.

    Only keys and rows are shuffled for all entries; a bit table of fixed size then lets the
    entries of repeated keys through.
    """
    entries = nodes.select("row", F.explode("prefix").alias("key"))
    repeated = entries.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most")
    slot = F.shiftrightunsigned(F.col("key"), 64 - table_bits)
    word = F.shiftright(slot, 6).cast("int").alias("word")
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")
    words = repeated.groupBy(word).agg(bit).toArrow()  # at most 2 ** table_bits / 64 rows
    table = np.zeros(2**table_bits // 64, dtype=np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shared.value, dtype=np.uint64)
        for batch in sliced(batches):
            prefix = batch.column(batch.num_columns - 1)
            keys = prefix.flatten().to_numpy(zero_copy_only=False)
            sizes = prefix.value_lengths().to_numpy(zero_copy_only=False)
            slots = (keys.view(np.uint64) >> np.uint64(64 - table_bits)).astype(np.int64)
            hit = np.flatnonzero(wanted[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1))
            at = np.repeat(np.arange(len(sizes)), sizes)
            places = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = [pa.array(c.to_numpy()[at[hit]]) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(places[hit].astype(np.int64)), pa.array(keys[hit])], names=[*names, "i", "key"])

    names = ["row", "n", "common", *MARKS]
    schema = "row long, n long, common double, " + "".join(f"{m} long, " for m in MARKS) + "i long, key long"
    return stored(nodes.select(*names, "prefix").mapInArrow(run, schema))


def _stars(met: DataFrame, turn: int) -> DataFrame:
    """(a, b): some nodes of each key with those of its other components.

    One is the node of the most frequent shingles: of a text and its copies with changes that is
    the text, as a change makes rare shingles. The others come first in an order by hashes, the same
    for all keys, anew every turn.
    """
    node = ("row", "n", "i", *MARKS, "component")
    firsts = [(-F.col("common")) if turn == 0 else F.xxhash64("row", F.lit(-turn))]
    firsts += [F.xxhash64("row", F.lit(turn * CENTRES + k)) for k in range(1, CENTRES)]
    centres = met.groupBy("key").agg(F.array(*(F.min(F.struct(f.alias("by"), *node)) for f in firsts)).alias("c"), F.count("*").alias("n_rows"))
    centres = cut(centres.withColumn("c", F.array_distinct(F.transform("c", lambda c: F.struct(*(c[x].alias(x) for x in node))))))
    pairs = lookup_join(met, centres, "key", "n_rows", met.count(), how="inner", nulls=False)
    near = F.filter("c", lambda c: (c["component"] != F.col("component")) & _may_reach(lambda x: c[x], F.col))
    pairs = pairs.select("row", F.explode(near).alias("c"))
    return pairs.select(F.least("row", "c.row").alias("a"), F.greatest("row", "c.row").alias("b")).distinct()


def _apart(entries: DataFrame, links: DataFrame) -> DataFrame:
    """The ``entries`` of keys whose rows ``links`` leave in several components, with the ``component``, the row itself
    without links, and ``size``, the entries of the key."""
    known = cut(connected_components(links, "a", "b").withColumnRenamed("node", "row"))
    met = entries.drop("component", "size").join(known, "row", "left").withColumn("component", F.coalesce("component", "row"))
    spread = met.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n_rows"))
    spread = cut(spread.where("lo < hi").select("key", "n_rows", F.col("n_rows").alias("size")))
    return stored(lookup_join(met, spread, "key", "n_rows", entries.count(), how="inner", nulls=False))


def _all_pairs(met: DataFrame) -> DataFrame:
    """(a, b): all pairs of a key that lie in different components and may be similar."""
    a, b = (met.select("key", *(F.col(c).alias(c + x) for c in ("row", "n", "i", *MARKS, "component"))) for x in "ab")
    pairs = a.join(b, F.expr("rowa < rowb and componenta <> componentb") & (a["key"] == b["key"]) & _may_reach(lambda c: F.col(c + "a"), lambda c: F.col(c + "b")))
    return pairs.select(F.col("rowa").alias("a"), F.col("rowb").alias("b")).distinct()


def _links(rows: DataFrame, nodes: DataFrame, shingle_words: int, table_bits: int) -> DataFrame:
    """Links (a, b) that join up all ``nodes`` (row, sim, n, common, prefix) with similar sets.

    First come the pairs of multi-index hashing. What they leave apart meets at the keys of
    its prefixes. At a key of few nodes all are compared; at others all are compared with a few of
    them, twice, and then only those that are still in different components pair by pair, so
    that many texts of one pattern do not meet in pairs. Every pair that is compared is compared
    by whole sets.
    """
    tried = cut(_hamming_pairs(nodes).distinct())
    links = cut(_similar(rows, tried, shingle_words))
    met = _apart(_repeated_entries(nodes, table_bits), links)
    many = met.where(F.col("size") > CENTRES)
    pairs = _all_pairs(met.where(F.col("size") <= CENTRES))
    for turn in range(STAR_ROUNDS + 1):
        stars = _stars(many, turn) if turn < STAR_ROUNDS else _all_pairs(many)
        pairs = cut((stars if turn else pairs.unionByName(stars).distinct()).join(tried.hint("merge"), ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        links = cut(links.unionByName(_similar(rows, pairs, shingle_words)))
        many = _apart(many, links) if turn < STAR_ROUNDS else many
    return links


def distinct_rows(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, sketch_bits: int = SKETCH_BITS, table_bits: int = TABLE_BITS) -> DataFrame:
    """One row of each group of near-duplicates, in all its columns.

    Rows are linked if the Jaccard similarity of their sets of shingles is at least
    SIMILAR, and grouped by links; of a group the row with the smallest doc_id stays,
    a null one last, and of repeated rows the first. Texts without words, null ones
    too, are alike. An empty table gives an empty result.
    """
    whole = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = texts(whole, F.col("__row").alias("row"))
    signed = stored(_signed(rows, _sketch(rows, shingle_words, sketch_bits), shingle_words, sketch_bits))
    total = signed.count()
    sets = cut(signed.groupBy("fp").agg(F.min("row").alias("node"), F.count("*").alias("n")))
    members = cut(lookup_join(signed.select("row", "doc_id", "fp"), sets, "fp", "n", total, nulls=False).drop("fp"))
    nodes = without(signed, members.where("row <> node").select("row"), "row").drop("doc_id", "fp")
    groups = cut(connected_components(_links(rows, nodes, shingle_words, table_bits), "a", "b"))
    linked = sets.join(groups, "node").select("node", "n", "component")
    members = cut(lookup_join(members, cut(linked), "node", "n", total, nulls=False).select("row", "doc_id", F.coalesce("component", "node").alias("component")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    several = members.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = lookup_join(members.select("row", "component"), cut(several), "component", "n", total, how="inner", nulls=False).where("row <> first.row")
    return without(whole, cut(gone.select(F.col("row").alias("__row"))), "__row").drop("__row")
