"""SimHash near-dedup with multi-index hashing over fingerprint segments."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pointloom.llm.common import LOWER, UPPER, map_arrow, texts
from pointloom.operators.graph import connected_components
from pointloom.plans.lineage import cut
from pointloom.plans.skew import lookup_join

BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEGMENTS = 2
#: Segment tables with more fingerprints under one key are searched by shared neighbours instead.
CROWDED = 64
HASH_SEED = 42

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLOCK = 4096


def simhash(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint: a bit is 1 if set in over half the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
        n = len(words) - shingle_words + 1
    hashes = np.fromiter((xxh64_intdigest(s, HASH_SEED) for s in shingles), dtype=">u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _BLOCK):
        block = hashes[i : i + _BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def as_long(fingerprint: int) -> int:
    return fingerprint - (1 << BITS) if fingerprint >> (BITS - 1) else fingerprint


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long) of each whole text; null texts count as empty."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "fp": [as_long(simhash(t, shingle_words)) for t in batch.column(1).to_pylist()]}

        return step

    return map_arrow(texts(docs), "doc_id long, fp long", make)


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for d in range(radius + 1) for c in combinations(range(bits), d)]


def _segment(fp: Column, no: int, segments: int) -> Column:
    width = BITS // segments
    return F.shiftrightunsigned(fp, no * width).bitwiseAND(F.lit(as_long((1 << width) - 1)).cast("long"))


def _radii(max_distance: int, segments: int) -> list[int]:
    """Radius of each segment's ball; -1: the segment need not be searched.

    Were every segment's distance above its radius, the whole distance would exceed
    ``max_distance``.
    """
    radius, rest = divmod(max_distance, segments)
    return [radius if i <= rest else radius - 1 for i in range(segments)]


def hamming_links(nodes: DataFrame, max_distance: int, segments: int, crowded: int) -> DataFrame:
    """Links (a, b) that join up all distinct fingerprints within ``max_distance`` bits.

    Every fingerprint is in each segment's table under its value there, and looks up
    the values in a small Hamming ball around it. Of two fingerprints only one looks
    the other up: the one that has 0 at the lowest bit in which the segments differ,
    or the lesser one where they are equal. Matches are verified on all bits.

    A key with more than ``crowded`` entries is not expanded into pairs. All
    fingerprints that meet at such keys are linked by shared neighbours: two are
    within 2k bits only if some value is within k bits of both, and a value has a
    fixed number of fingerprints that near.
    """
    fp = F.col("fp")
    radii = _radii(max_distance, segments)
    used = [i for i in range(segments) if radii[i] >= 0]
    width = BITS // segments
    entry = F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), _segment(fp, i, segments).alias("key")) for i in used)))
    entries = nodes.select("fp", entry.alias("e")).select("fp", "e.seg", "e.key")

    def ball(i: int) -> Column:
        value = _segment(fp, i, segments)
        masks = F.array(*(F.lit(as_long(m)).cast("long") for m in _masks(width, radii[i])))
        near = F.filter(masks, lambda m: (m == 0) | (value.bitwiseAND(m.bitwiseAND(-m)) == 0))
        return F.transform(near, lambda m: F.struct(F.lit(i).alias("seg"), value.bitwiseXOR(m).alias("key"), (m == 0).alias("same")))

    probe = F.explode(F.concat(*(ball(i) for i in used)))
    probes = nodes.select("fp", probe.alias("p")).select("fp", "p.seg", "p.key", "p.same")
    busy = cut(entries.groupBy("seg", "key").count().where(F.col("count") > crowded).select("seg", "key"))
    any_busy = busy.limit(1).count() > 0
    table = entries.join(busy, ["seg", "key"], "left_anti") if any_busy else entries
    met = probes.withColumnRenamed("fp", "a").join(table.withColumnRenamed("fp", "b"), ["seg", "key"])
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    links = met.where((~F.col("same") | (F.col("a") < F.col("b"))) & (distance <= max_distance)).select("a", "b")
    if not any_busy:
        return links
    meeting = probes.select("fp", "seg", "key").join(busy, ["seg", "key"], "left_semi").select("fp")
    meeting = meeting.unionByName(entries.join(busy, ["seg", "key"], "left_semi").select("fp")).distinct()
    masks = F.array(*(F.lit(as_long(m)).cast("long") for m in _masks(BITS, max_distance // 2)))
    around = meeting.select("fp", F.explode(F.transform(masks, lambda m: fp.bitwiseXOR(m))).alias("near"))
    shared = around.groupBy("near").agg(F.sort_array(F.collect_set("fp")).alias("f")).where(F.size("f") > 1)
    return links.unionByName(shared.select(F.col("f")[0].alias("a"), F.explode(F.slice("f", 2, 1 << 30)).alias("b")))


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    segments: int = SEGMENTS,
    crowded: int = CROWDED,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach. Null and wordless texts have
    fingerprint zero and link like any other. Rows with a null doc_id are members
    whose id never is the smallest (it is null where all of a component's are). An
    empty table gives an empty result. ``max_distance`` must be even.
    """
    if max_distance % 2:
        raise ValueError("max_distance must be even")
    rows = cut(fingerprints(docs, shingle_words))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    component = cut(connected_components(hamming_links(nodes.select("fp"), max_distance, segments, crowded), "a", "b"))
    members = component.withColumnRenamed("node", "fp").join(nodes, "fp")
    members = cut(members.select("fp", "component", "least"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    linked = lookup_join(members, cut(least), "component", "n", members.count(), nulls=False)
    linked = linked.select("fp", "component_id", F.lit(True).alias("linked"))
    table = nodes.join(linked, "fp", "left")
    table = table.select("fp", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    joined = lookup_join(rows, cut(table), "fp", "n", rows.count(), nulls=False)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
