"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

A text is compared after deleting every character of ``[\\x20\\x09-\\x0D]``. Its
fingerprint is the polynomial of its bytes in base 256 modulo a large prime, so the
fingerprints of two chunks combine to that of their concatenation:
``f(ab) = f(a) * 256 ** len(b) + f(b)``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pointloom.llm.common import SPACE_BYTES, map_arrow, sliced, texts
from pointloom.plans.lineage import cut
from pointloom.plans.skew import lookup_join

#: The largest prime below 2**126.
MODULUS = 2**126 - 137
CHUNK_BYTES = 1 << 16
#: Texts of more characters are cut into chunks that different tasks hash.
HUGE_CHARS = 1 << 25
HUGE_CHUNK_CHARS = 1 << 22
#: Bits of the table that says which fingerprints may occur twice; its size is fixed (8 MB).
TABLE_BITS = 26

_ROWS = "doc_id long, row long, t string, n_chars long, fp binary, sha binary"


def chunks(data: bytes, size: int = CHUNK_BYTES):
    """``data`` in pieces of ``size`` bytes; one empty piece if there is none."""
    return (data[i : i + size] for i in range(0, max(len(data), 1), size))


def combine(left: tuple[int, int], right: tuple[int, int], modulus: int = MODULUS) -> tuple[int, int]:
    """(fingerprint, length) of a concatenation from those of its two parts."""
    return (left[0] * pow(256, right[1], modulus) + right[0]) % modulus, left[1] + right[1]


def fingerprint(data: bytes, modulus: int = MODULUS) -> tuple[int, int]:
    """(fingerprint, length), chunk by chunk."""
    whole = (0, 0)
    for part in chunks(data):
        whole = combine(whole, (int.from_bytes(part) % modulus, len(part)), modulus)
    return whole


def _packed(value: tuple[int, int]) -> bytes:
    """16 bytes of fingerprint, then 8 of length: what equal texts share."""
    return value[0].to_bytes(16) + value[1].to_bytes(8)


def _normal(text: str) -> bytes:
    return text.encode().translate(None, SPACE_BYTES)


def _fingerprinted(docs: DataFrame, huge_chars: int, modulus: int) -> DataFrame:
    """A row per document with its row number, digests and fingerprint; null for a huge text."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            fps, shas, sizes = [], [], []
            for text in batch.column(3).to_pylist():
                data = _normal(text)
                sizes.append(len(text))
                shas.append(hashlib.sha256(data).digest())
                fps.append(None if len(text) > huge_chars else _packed(fingerprint(data, modulus)))
            return {"doc_id": batch.column(0), "row": batch.column(1), "t": batch.column(2), "n_chars": sizes, "fp": fps, "sha": shas}

        return step

    own = F.when(F.char_length("text") > huge_chars, F.sha2("text", 256))
    numbered = texts(docs).select("doc_id", F.monotonically_increasing_id(), own, "text")
    return map_arrow(numbered, _ROWS, make)


def _huge_fingerprints(docs: DataFrame, huge_chars: int, chunk_chars: int, modulus: int) -> DataFrame:
    """(t, fp) of texts over ``huge_chars``: chunks are dealt out, hashed in parallel and combined."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            parts = [fingerprint(_normal(x), modulus) for x in batch.column(2).to_pylist()]
            return {"t": batch.column(0), "no": batch.column(1), "part": [_packed(x) for x in parts]}

        return step

    def fold(parts: pa.Array) -> bytes:
        whole = (0, 0)
        for part in parts:
            whole = combine(whole, (int.from_bytes(part[:16]), int.from_bytes(part[16:])), modulus)
        return _packed(whole)

    def make_fold():
        return lambda b: {"t": b.column(0), "huge_fp": [fold(x) for x in b.column(1).to_pylist()]}

    size = F.char_length("text")
    huge = texts(docs).where(size > huge_chars).select(F.sha2("text", 256).alias("t"), "text").dropDuplicates(["t"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text in one pass, without a copy of the whole beside each chunk."""
        for batch in sliced(batches, 1):
            t, text = batch.column(0), batch.column(1)[0].as_py()
            for no, i in enumerate(range(0, len(text), chunk_chars)):
                yield pa.RecordBatch.from_arrays([t, pa.array([no], pa.int32()), pa.array([text[i : i + chunk_chars]])], names=["t", "no", "x"])

    dealt = huge.mapInArrow(cut_up, "t string, no int, x string")
    hashed = map_arrow(dealt.repartition("t", "no"), "t string, no int, part binary", make)
    ordered = hashed.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("no", "part"))).alias("s"))
    return map_arrow(ordered.select("t", F.col("s.part")), "t string, huge_fp binary", make_fold)


def _twice_table(repeated: DataFrame, bits: int = TABLE_BITS) -> bytes:
    """A bit table over hashes of the fingerprints that occur more than once.

    At most ``2 ** bits / 64`` words come to the driver, whatever the input's size. A
    full table would let every text through to the comparison, which stays exact.
    """
    slot = F.col("slot")
    words = (
        repeated.select(F.shiftrightunsigned(F.xxhash64("fp"), 64 - bits).alias("slot"))
        .groupBy((slot / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    )
    out = np.zeros(2**bits // 64, dtype=np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.tobytes()


def _unequal(docs: DataFrame, table: bytes, bits: int, modulus: int) -> DataFrame:
    """Fingerprints whose texts differ somewhere: each chunk is compared as a minimum against a maximum.

    Both are aggregated before the shuffle, so a group of any size sends at most two
    copies of its text from a task, and no task holds more than a few chunks.
    """
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        twice = np.frombuffer(shared.value, dtype=np.uint64)

        def may_repeat(fp: bytes) -> bool:
            slot = xxhash.xxh64_intdigest(fp, 42) >> (64 - bits)
            return bool((int(twice[slot >> 6]) >> (slot & 63)) & 1)

        def rows(texts_: list):
            for text in texts_:
                data = _normal(text)
                fp = _packed(fingerprint(data, modulus))
                if may_repeat(fp):
                    yield from ((fp, no, part) for no, part in enumerate(chunks(data)))

        return rows

    schema = pa.schema([("fp", pa.binary()), ("no", pa.int32()), ("part", pa.binary())])

    def run(batches):
        found = make()
        for batch in batches:
            held, size = [], 0
            for row in found(batch.column(0).to_pylist()):
                held.append(row)
                size += len(row[2])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)

    parts = texts(docs).select("text").mapInArrow(run, "fp binary, no int, part binary")
    compared = parts.groupBy("fp", "no").agg((F.min("part") == F.max("part")).alias("same"))
    return compared.where(~F.col("same")).select("fp").distinct()


def _order(row: dict[str, Column]) -> Column:
    """Most characters first, then the smallest doc_id (null last), then the earliest of repeated rows."""
    return F.struct(-row["n_chars"], row["doc_id"].isNull(), row["doc_id"], row["row"])


def exact_groups(
    docs: DataFrame,
    huge_chars: int = HUGE_CHARS,
    huge_chunk_chars: int = HUGE_CHUNK_CHARS,
    modulus: int = MODULUS,
    table_bits: int = TABLE_BITS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the most characters
    stays, then the smallest doc_id, a null one last; of fully repeated rows exactly
    one is kept. An empty table gives an empty result. Columns besides doc_id and
    text are not read.

    Fingerprints are written once (about 100 bytes a document); texts move only to be
    compared, and then only those whose fingerprint may occur twice. Groups that the
    comparison splits are told apart by their SHA-256.
    """
    rows = cut(_fingerprinted(docs, huge_chars, modulus))
    huge = rows.where("fp is null")
    if huge.limit(1).count():
        found = huge.join(_huge_fingerprints(docs, huge_chars, huge_chunk_chars, modulus), "t")
        found = found.select("doc_id", "row", "t", "n_chars", F.col("huge_fp").alias("fp"), "sha")
        rows = cut(rows.where("fp is not null").unionByName(found))
    repeated = rows.groupBy("fp").count().where("count > 1")
    rows = rows.withColumn("key", F.col("fp"))
    table = _twice_table(repeated, table_bits)
    if any(table):
        unequal = cut(_unequal(docs, table, table_bits, modulus))
        if unequal.limit(1).count():
            marked = rows.join(unequal.withColumn("split", F.lit(True)), "fp", "left")
            rows = marked.withColumn("key", F.when(F.col("split"), F.concat("fp", "sha")).otherwise(F.col("fp"))).drop("split")
    columns = {c: F.col(c) for c in ("n_chars", "doc_id", "row")}
    groups = rows.groupBy("key").agg(F.min(_order(columns)).alias("first"), F.count("*").alias("group_size"))
    groups = groups.select("key", "group_size", F.col("group_size").alias("n"), F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    joined = lookup_join(rows, groups, "key", "n", rows.count())
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


op5 = partial(exact_groups)

ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY n_chars DESC, doc_id NULLS LAST)
"""
