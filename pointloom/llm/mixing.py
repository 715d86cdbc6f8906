"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document has an expected number of copies, in proportion to its inclusion weight and
such that its source's words come to their target. The whole part is certain; for the rest,
documents are ranked by their random odds over their inclusion odds. Where a source's sample
ends is one place in the order of ranks, so each row can tell its copies from its own values
and a table with a row a source: no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pointloom.llm.common import WORD
from pointloom.plans.lineage import cut
from pointloom.plans.skew import among, lookup_join

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Ranks are cut into so many bins a source, and the bin in which the sample ends into as many again, so
#: that little of a source is put in order in one task and the sums over its bins are few.
BINS = 256
SEED = "mix"
_UNIT = 1 << 52
_NO_ID = -(1 << 63)


def binary_digits(size: Column) -> Column:
    """The default inclusion weight: the number of binary digits of a document's size, so that longer texts are likelier."""
    return F.length(F.bin(size))


def _plain(docs: DataFrame, weight: Column | None, *more: str) -> DataFrame:
    """doc_id, source, text, the weight as given and ``more`` columns, under names that clash with none used here."""
    given = F.lit(None) if weight is None else weight
    return docs.select("doc_id", "source", "text", given.cast("double").alias("__given"), *(F.col(f"`{c}`").alias(f"__c_{c}") for c in more))


def _sized(plain: DataFrame, weighted: bool) -> DataFrame:
    """Adds __size, the words in the text; __weight; __h, a hash of the text; and __u, a random number in (0, 1).

    Weights have eight significant bits, so that a source has few distinct ones. The random
    number comes from the id, or from the text where that is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = plain.withColumn("__size", F.regexp_count(text, F.lit(WORD)).cast("long"))
    given = F.col("__given") if weighted else binary_digits(F.col("__size")).cast("double")
    given = F.when((given > 0) & (given < float("inf")), given).otherwise(1.0)
    grain = F.pow(F.lit(2.0), F.floor(F.log2(given)) - 7)
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), F.md5(text.cast("binary"))))
    digest = F.md5(F.concat(F.lit(SEED + "|"), named).cast("binary"))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return sized.withColumns({"__weight": F.floor(given / grain) * grain, "__h": F.xxhash64(text), "__u": (number + F.lit(0.5)) / F.lit(float(_UNIT))})


def _targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Adds ``target``: weights times one level, but at most ``most`` times the source's size.

    Handing the excess of capped sources to the others by weight, again and again, ends
    at the level at which the targets add up to all sizes. Sources are put in the
    order in which they reach their caps; the level follows from running sums. The
    table has one row a source, and one task puts the sources in order.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(order) - 1) % len(weights) + 1
    share = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), nth)
    s = sources.withColumn("share", share).withColumn("cap", F.col("source_size") * F.lit(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("share"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_share = F.sum("share").over(everything) - F.coalesce(F.sum("share").over(before), F.lit(0.0))
    s = s.withColumn("level", rest / open_share).withColumn("below", F.col("level") * F.col("share") <= F.col("cap"))
    level = F.first(F.when(F.col("below"), F.col("level")), ignorenulls=True)
    s = s.withColumn("final", level.over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("share"), F.col("cap").cast("double")))
    return s.withColumn("target", target).drop("share", "cap", "level", "below", "final")


def _levels(rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """(source, n_rows, source_size, target, level): a document expects level times its weight copies, at most ``most``.

    What the documents at ``most`` leave over is handed to the others of their source: the
    weights are put in the order in which they reach it, the greatest first.
    """
    groups = rows.groupBy("source", "__weight").agg(F.sum("__size").alias("words"), F.count("*").alias("n"))
    groups = cut(groups)
    sources = groups.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_rows"))
    targets = _targets(sources, weights, most).withColumnRenamed("source", "__source")
    falling = Window.partitionBy("source").orderBy(F.col("__weight").desc())
    before = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("words") * F.col("__weight")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = groups.withColumn("before", before).withColumn("mass", mass)
    found = found.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    level = (F.col("target") - F.col("before") * most) / F.when(F.col("mass") > 0, F.col("mass"))
    found = found.withColumn("level", level)
    below = F.min(F.when(F.col("level") * F.col("__weight") <= most, F.struct((-F.col("__weight")).alias("w"), "level")))
    firsts = [F.first(c).alias(c) for c in ("n_rows", "source_size", "target")]
    return found.groupBy("source").agg(*firsts, below.alias("below")).select("source", "n_rows", "source_size", "target", F.col("below.level").alias("level"))


def _ranked(rows: DataFrame, most: int, bins: int) -> DataFrame:
    """Adds the certain copies __base, the place in the order of Pareto ranks, and which of ``bins`` squared bins that is in.

    The bin is null for what has no part to sample.
    """
    expected = F.least(F.coalesce(F.col("level") * F.col("__weight"), F.lit(float(most))), F.lit(float(most)))
    rows = rows.withColumn("__expected", F.when(F.col("source_size") > 0, expected).otherwise(0.0))
    rows = rows.withColumn("__base", F.floor("__expected")).withColumn("__part", F.col("__expected") - F.col("__base"))
    odds = F.col("__u") / (1 - F.col("__u"))
    rank = F.when(F.col("__part") > 0, odds / (F.col("__part") / (1 - F.col("__part"))))
    rows = rows.withColumn("__rank", rank)
    # rank / (1 + rank) puts the ranks into (0, 1) in the same order.
    fine = F.least(F.floor(F.col("__rank") / (1 + F.col("__rank")) * (bins * bins)), F.lit(bins * bins - 1))
    place = F.struct(F.coalesce("__rank", F.lit(float("inf"))).alias("rank"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("__size").alias("size"), F.col("__h").alias("h"))
    return rows.withColumns({"__fine": F.when(F.col("__part") > 0, fine), "__place": place}).drop("__expected", "__part", "__rank", "__u", "__weight", "__h")


def _filled(sums: DataFrame, by: str, start: Column) -> DataFrame:
    """(source, end): of each source the first of the bins ``by`` in which ``rest`` is reached, and the words before it."""
    running = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    upto = sums.withColumn("before", start + F.coalesce(F.sum("words").over(running), F.lit(0)))
    here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    return upto.groupBy("source").agg(F.first("rest").alias("rest"), F.min(F.when(here, F.struct(F.col(by).alias("bin"), "before"))).alias("end"))


def _ends(ranked: DataFrame, bins: int) -> DataFrame:
    """(source, end_fine, end, n_end, missing): where the sample of each source ends.

    All of the bins before ``end_fine`` is taken; in it all before the place ``end`` and
    ``n_end`` of the rows at it. ``missing`` words are then still missing.
    """
    coarse = F.floor(F.col("__fine") / bins).alias("coarse")
    sums = ranked.groupBy("source", coarse).agg(
        F.sum("__size").alias("words"), F.sum(F.col("__base") * F.col("__size")).alias("whole"), F.first("target").alias("target"), F.count("*").alias("n")
    )
    all_of = Window.partitionBy("source")
    sums = sums.withColumn("rest", F.col("target") - F.sum("whole").over(all_of)).withColumn("n_rows", F.sum("n").over(all_of))
    rests = sums.groupBy("source").agg(F.first("rest").alias("rest"), F.first("n_rows").alias("n_rows"), F.sum(F.when(F.col("coarse").isNotNull(), F.col("words"))).alias("open"))
    first = _filled(sums.where("coarse is not null"), "coarse", F.lit(0)).select(F.col("source").alias("__s"), "end")
    rests = cut(rests.join(first, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    inside = lookup_join(ranked.where("__fine is not null").select("source", "__fine", "__place", "__size"), rests, "source", "n_rows", ranked.count())
    inside = cut(inside.where(F.floor(F.col("__fine") / bins) == F.col("end.bin")).withColumn("from", F.col("end.before")).drop("end", "open"))
    subs = inside.groupBy("source", "__fine").agg(F.sum("__size").alias("words"), F.first("rest").alias("rest"), F.first("from").alias("from"), F.count("*").alias("n"))
    subs = subs.withColumn("n_rows", F.sum("n").over(all_of))
    second = _filled(subs, "__fine", F.col("from")).select(F.col("source").alias("__s"), F.col("end").alias("sub"))
    sizes = subs.groupBy("source").agg(F.first("n_rows").alias("n_rows"))
    second = cut(sizes.join(second, F.col("source").eqNullSafe(F.col("__s"))).drop("__s"))
    last = lookup_join(inside, second, "source", "n_rows", inside.count()).where(F.col("__fine") == F.col("sub.bin"))
    upto = F.col("sub.before") + F.sum("__size").over(Window.partitionBy("source").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    taken = last.withColumn("upto", upto).withColumn("more", F.col("upto") <= F.col("rest"))
    end = F.max(F.when(F.col("more"), F.col("__place")))
    taken = taken.withColumn("end", end.over(all_of))
    n_end = F.count(F.when(F.col("more") & (F.col("__place") == F.col("end")), 1))
    got = F.coalesce(F.max(F.when(F.col("more"), F.col("upto"))), F.first("sub.before"))
    ends = taken.groupBy("source").agg(F.first("sub.bin").alias("end_fine"), F.first("end").alias("end"), n_end.alias("n_end"), got.alias("got"))
    ends = rests.select("source", "rest", "open").join(ends.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    none = F.when(F.col("rest") > 0, F.lit(bins * bins)).otherwise(F.lit(-1))
    left = F.col("rest") - F.coalesce(F.col("got"), F.when(F.col("rest") > 0, F.coalesce("open", F.lit(0))).otherwise(0))
    return ends.select("source", F.coalesce("end_fine", none).alias("end_fine"), "end", F.coalesce("n_end", F.lit(0)).alias("n_end"), left.alias("missing"))


def _before_end() -> Column:
    """Whether a row is taken because its place lies before the end, whatever rows are at the end itself."""
    at = F.col("__fine") == F.col("end_fine")
    return F.coalesce((F.col("__fine") < F.col("end_fine")) | (at & (F.col("__place") < F.col("end"))), F.lit(False))


def _sources(rows: DataFrame, weights: tuple[float, ...], most: int, bins: int) -> tuple[DataFrame, int]:
    """The table of sources by which each row can tell its copies, and the number of rows.

    ``best`` is the place of the document that comes nearest to the missing words, if any comes nearer than none.
    """
    total = rows.count()
    levels = cut(_levels(rows, weights, most))
    ranked = cut(_ranked(lookup_join(rows, levels, "source", "n_rows", total), most, bins))
    same = F.col("source").eqNullSafe(F.col("__s"))
    table = cut(levels.join(_ends(ranked, bins).withColumnRenamed("source", "__s"), same, "left").drop("__s"))
    placed = lookup_join(ranked.drop("source_size", "target", "level"), table, "source", "n_rows", total)
    at_end = F.coalesce(F.col("__place") == F.col("end"), F.lit(False))
    gap = F.abs(F.col("missing") - F.col("__size"))
    open_ = placed.where(~_before_end() & (F.col("__base") < most) & (gap < F.col("missing")))
    # Of the rows at the end, which are alike, n_end are taken; one more is open if there are more of them.
    open_ = open_.groupBy("source", "__place", "n_end").agg(F.min(gap).alias("gap"), F.first(at_end).alias("at_end"), F.count("*").alias("n"))
    open_ = open_.where(~F.col("at_end") | (F.col("n") > F.col("n_end")))
    best = open_.groupBy("source").agg(F.min(F.struct("gap", F.col("__place").alias("place"))).alias("b"))
    best = best.select(F.col("source").alias("__s"), F.col("b.place").alias("best"))
    return cut(table.join(best, same, "left").drop("__s", "missing")), total


def _copies(rows: DataFrame, edge_rows: DataFrame, table: DataFrame, total: int, most: int, bins: int) -> DataFrame:
    """Sized ``rows`` with source_size, target and __copies, by the table of sources.

    ``edge_rows`` are those whose ids are at an end. Rows at the end of a sample that are alike
    in id and text share out what is taken of them.
    """
    at_end, at_best = (F.coalesce(F.col("__place") == F.col(c), F.lit(False)) for c in ("end", "best"))
    nth = F.row_number().over(Window.partitionBy("source", "__place").orderBy("__size"))
    n_end = F.when(at_end, F.col("n_end")).otherwise(0) + at_best.cast("int")
    placed = lambda some: _ranked(lookup_join(some, table, "source", "n_rows", total), most, bins)
    edge = placed(edge_rows).where(at_end | at_best).withColumn("__more", nth <= n_end)
    rest = placed(rows).where(~(at_end | at_best)).withColumn("__more", _before_end())
    made = rest.unionByName(edge).withColumn("__copies", (F.col("__base") + F.col("__more").cast("long")).cast("long"))
    return made.drop("__base", "__more", "__fine", "__place", "level", "end_fine", "end", "n_end", "best")


def _at_ends(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The rows whose id is that of a row at the end of a source's sample."""
    ids = cut(table.select(F.explode(F.array("end.id", "best.id")).alias("__id")).dropna().distinct())
    return among(docs.withColumn("__id", F.coalesce("doc_id", F.lit(_NO_ID))), ids, "__id").drop("__id")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, weight: Column | None = None, bins: int = BINS) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    ``weight`` is the inclusion weight of a document within its source, by default the
    number of binary digits of its size; values that are not above 0 count as 1, and all
    have eight significant bits. Expected copies are in proportion to it, up to ``most``;
    what is over goes to the others. Whole copies are certain, the rest is a Pareto
    order sample whose words fill what the source's target leaves. Where it ends within a
    document, the document that comes nearest to what is missing completes it, if any comes
    nearer than none, so that a source's words are within half a document of its target.

    A null text has size 0; sources that are null form one source, the last. Random
    numbers come from doc_id, or from the text where that is null, so reruns agree however
    rows are split. Equal ranks are decided by id (a null one first), size and a hash of the
    text; rows alike in all that share out what is taken of them. Sources of size 0 have
    target 0 and no copies, an empty table gives an empty result. One task holds a row a
    source to set the targets.
    """
    sized = _sized(_plain(docs, weight), weight is not None)
    rows = cut(sized.select("doc_id", "source", "__size", "__weight", "__h", "__u"))
    table, total = _sources(rows, weights, most, bins)
    made = _copies(rows, _at_ends(rows, table), table, total, most, bins)
    return made.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def repeat_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, weight: Column | None = None, bins: int = BINS) -> DataFrame:
    """Each row of ``docs``, with all its columns, as often as ``mix`` takes it. Of texts only those of rare sources are shuffled."""
    plain, weighted = _plain(docs, weight, *docs.columns), weight is not None
    rows = _sized(plain, weighted)
    table, total = _sources(cut(rows.select("doc_id", "source", "__size", "__weight", "__h", "__u")), weights, most, bins)
    made = _copies(rows, _sized(_at_ends(plain, table), weighted), table, total, most, bins).where("__copies > 0")
    made = made.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))))
    return made.select(*(F.col(f"`__c_{c}`").alias(c) for c in docs.columns))


def op4(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (sum(size) * 3)::DOUBLE AS cap,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS share
  FROM d GROUP BY source),
w AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER c, 0)) / (sum(share) OVER () - coalesce(sum(share) OVER c, 0)) AS level
  FROM s WINDOW c AS (ORDER BY cap / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, (SELECT arg_min(level, cap / share) FROM w WHERE level * share <= cap) * share) AS target
  FROM w),
p AS (
  SELECT source, length(bin(size)) AS weight, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
q AS (
  SELECT p.source, p.weight,
         (t.target - (3 * coalesce(sum(p.words) OVER (PARTITION BY p.source ORDER BY p.weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
         / nullif(sum(p.words * p.weight) OVER (PARTITION BY p.source ORDER BY p.weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS level
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
l AS (
  SELECT source, arg_max(level, weight) FILTER (level * weight <= 3) AS level FROM q GROUP BY source),
e AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(coalesce(l.level * length(bin(d.size)), 3.0::DOUBLE), 3.0::DOUBLE) ELSE 0 END AS expected
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN l ON d.source IS NOT DISTINCT FROM l.source),
r AS (
  SELECT *, floor(expected)::BIGINT AS base,
         CASE WHEN expected > floor(expected)
              THEN u / (1 - u) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS rank
  FROM e),
f AS (
  SELECT *, target - sum(base * size) OVER (PARTITION BY source) AS rest,
         sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM r),
g AS (
  SELECT *, rank IS NOT NULL AND upto <= rest AS more,
         rest - coalesce(sum(size) FILTER (rank IS NOT NULL AND upto <= rest) OVER (PARTITION BY source), 0) AS missing FROM f),
h AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY more OR base >= 3 OR abs(missing - size) >= missing, abs(missing - size), rank NULLS LAST, doc_id) = 1
            AND NOT (more OR base >= 3 OR abs(missing - size) >= missing) AS completes FROM g)
SELECT doc_id, size, source_size, target, ((base + CASE WHEN more OR completes THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM h
"""
