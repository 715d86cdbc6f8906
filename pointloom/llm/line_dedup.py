"""Line dedup with DataFrame functions only.

Hashes of the lines are range-partitioned and sorted by hash, document and position;
the keepers come first in each hash's stream. What goes back to a document is the
bitmap of the lines that it keeps, compressed to the runs of its zeros, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pointloom.llm.common import SPACE, lower_ascii, texts
from pointloom.plans.lineage import cut

MIN_CHARS = 20
MIN_DOCUMENTS = 3
#: Frequent hashes are sought in so many groups, with a sketch of so many items each, which
#: cannot miss one that holds over a 2000th of all lines.
SKETCH_GROUPS, SKETCH_ITEMS, SKETCH_TOP = 64, 256, 64
HOT_SHARE = _SKETCH_SHARE = 2000
#: With more partitions than that, hashes that hold over one partition's share are sought, up to this many.
MOST_HOT_SHARE = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t, pos, h1, h2) of each line whose key is long enough.

    h1 and h2 are hashes of the key with different seeds, 128 bits together; t is a
    hash of the text, which tells apart rows that share a doc_id.
    """
    line = texts(docs).select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = line.select("doc_id", "t", "pos", lower_ascii(F.btrim("line", F.lit(SPACE))).alias("key"))
    long_enough = keyed.where(F.char_length("key") >= min_chars)
    return long_enough.select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _hot(lines: DataFrame) -> DataFrame:
    """The h1 of over a HOT_SHARE-th of all lines, or of a shuffle partition's share, from mergeable sketches of all lines.

    Which keys are listed, fewer than the number of shares, decides only how they are processed,
    not the result. Tasks send sketches of a fixed size; there are as many groups of them as it
    takes for one to find every key above the limit.
    """
    share = HOT_SHARE
    if HOT_SHARE:  # 0: no hash is hot
        share = min(max(HOT_SHARE, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_HOT_SHARE)
    groups = SKETCH_GROUPS * max(1, -(-share // _SKETCH_SHARE))
    top = F.expr(f"approx_top_k(h1, {SKETCH_TOP}, {SKETCH_ITEMS})").alias("top")
    sketches = lines.groupBy(F.pmod("h1", F.lit(groups)).alias("g")).agg(top)
    found = sketches.select(F.explode("top").alias("hot")).where(F.col("hot.item").isNotNull())
    return found.where(F.col("hot.count") * share > lines.count()).select(F.col("hot.item").alias("h1"))


def _dropped_light(lines: DataFrame, min_documents: int) -> DataFrame:
    """Drops under keys that are not hot: one range shuffle, then a stream in sorted order.

    In a key's stream the documents come from the largest id down, so the lines of its
    first document are the ones to keep.
    """
    largest_first = F.col("doc_id").desc_nulls_last()
    dealt = lines.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", largest_first, "pos")
    key = Window.partitionBy("h1", "h2")
    ranked = dealt.withColumn("nth", F.dense_rank().over(key.orderBy(largest_first))).withColumn("n_docs", F.max("nth").over(key))
    return ranked.where((F.col("nth") > 1) & (F.col("n_docs") >= min_documents)).select("doc_id", "t", "pos")


def _dropped_hot(lines: DataFrame, min_documents: int) -> DataFrame:
    """Drops under hot keys: counted per key and document before per key, then looked up by broadcast.

    There are as many keys as listed hashes, and more only if long lines share 64 bits.
    """
    per_document = lines.select("h1", "h2", "doc_id").distinct()
    keys = per_document.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
    keys = keys.where(F.col("n_docs") >= min_documents).select("h1", "h2", "last")
    met = lines.join(F.broadcast(keys), ["h1", "h2"])
    return met.where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "t", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, t, dropped, n_dropped): the keep bitmaps of the documents that lose lines.

    ``dropped`` is the bitmap as the sorted runs (start, n) of its zeros, ``n_dropped``
    their sum; all other lines are kept. A hash with very many lines is never gathered
    in one task.
    """
    lines = cut(_hashed_lines(docs, min_chars))
    hot = cut(_hot(lines))
    light = lines.join(F.broadcast(hot), "h1", "left_anti")
    heavy = lines.join(F.broadcast(hot), "h1", "left_semi")
    drops = _dropped_light(light, min_documents).unionByName(_dropped_hot(heavy, min_documents)).distinct()
    row = Window.partitionBy("doc_id", "t").orderBy("pos")
    runs = drops.withColumn("run", F.col("pos") - F.row_number().over(row))
    runs = runs.groupBy("doc_id", "t", "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"))
    bitmap = F.sort_array(F.collect_list(F.struct("start", "n"))).alias("dropped")
    return runs.groupBy("doc_id", "t").agg(bitmap, F.sum("n").alias("n_dropped"))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """``lines`` without the runs in ``dropped``: the slices between them, in time linear in both."""
    n = F.size(dropped)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(dropped, i)["start"] + F.element_at(dropped, i)["n"])
    end = lambda i: F.when(i == n, F.size(lines)).otherwise(F.element_at(dropped, i + 1)["start"])
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))


def _kept(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """Every row of ``docs``, its columns as __x_<name>, with __n_lines, __n_dropped and __kept, the text that stays."""
    bitmaps = keep_bitmaps(docs, min_chars, min_documents)
    bitmaps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("dropped").alias("__dropped"), F.col("n_dropped").alias("__n"))
    own = docs.select(*(F.col(f"`{c}`").alias(f"__x_{c}") for c in docs.columns), F.coalesce("text", F.lit("")).alias("__text"))
    joined = own.join(bitmaps, F.col("__x_doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("__text") == F.col("__t")), "left")
    lines = _lines(F.col("__text"))
    kept = F.when(F.col("__dropped").isNull(), F.col("__text")).otherwise(F.concat_ws("\n", kept_lines(lines, F.col("__dropped"))))
    return joined.withColumns({"__n_lines": F.size(lines).cast("long"), "__n_dropped": F.coalesce("__n", F.lit(0)).cast("long"), "__kept": kept})


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``extra`` columns of the input, n_lines, n_dropped and the kept text, one row per input row.

    A null or empty text is one empty line, which is too short to be dropped; the kept
    text is then empty. A text that loses all its lines becomes empty. Documents are
    told apart by doc_id: rows that share one count once and keep or lose a key
    together; null is an id below all others. An empty table gives an empty result.
    """
    made = _kept(docs.select("doc_id", "text", *(F.col(f"`{c}`") for c in extra)), min_chars, min_documents)
    own = [F.col(f"`__x_{c}`").alias(c) for c in ("doc_id", *extra)]
    return made.select(*own, F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__kept").alias("kept_text"))


def clean_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with all its columns, the texts without their dropped lines, and n_chars, if there is one, to match; null texts stay null."""
    made, dropped = _kept(docs, min_chars, min_documents), F.col("__n_dropped") > 0
    new = {"text": F.when(dropped, F.col("__kept")).otherwise(F.col("__x_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(dropped, F.char_length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__x_n_chars"))
    return made.select(*(new.get(c, F.col(f"`__x_{c}`")).alias(c) for c in docs.columns))


def op8(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.last AS drop
  FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
