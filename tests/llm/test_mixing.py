import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pointloom.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; the excess over the cap is handed on until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        open_ = {s: w[s] for s in names if s not in fixed}
        share = {s: rest * w[s] / sum(open_.values()) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def check(docs, **how):
    got = M.mix(docs, **how).collect()
    assert len(got) == docs.count()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    return sorted((str(r.doc_id), r.size, r.taken) for r in got)


def test_edge_cases_and_reruns(edge_docs):
    assert check(edge_docs) == check(edge_docs.repartition(5))


def test_small_table(small):
    check(small)


def test_sizes_are_words(edge_docs):
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in edge_docs.collect() if r.doc_id}
    assert {r.doc_id: r.size for r in M.op4(edge_docs).collect() if r.doc_id} == words


def brute(rows, weight, weights=(5, 2, 1), most=3):
    """{doc_id: copies} of rows (doc_id, text, source), worked out source by source in plain loops."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = defaultdict(list)
    for i, _, s in rows:
        sources[s].append(i)
    want = targets({s: sum(size[i] for i in ids) for s, ids in sources.items()}, weights, most)
    copies = {}
    for s, ids in sources.items():
        target, capped = want[s], set()
        while True:  # hand what the capped ones leave over to the others until none is above
            mass = sum(size[i] * weight(size[i], i) for i in ids if i not in capped)
            level = (target - most * sum(size[i] for i in capped)) / mass if mass else 0
            over = {i for i in ids if i not in capped and level * weight(size[i], i) > most}
            if not over:
                break
            capped |= over
        expected = {i: most if i in capped else level * weight(size[i], i) for i in ids}
        base = {i: math.floor(e) for i, e in expected.items()}
        rest = target - sum(base[i] * size[i] for i in ids)
        ranks = {}
        for i in ids:
            part, u = expected[i] - base[i], (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if part > 0:
                ranks[i] = (u / (1 - u)) / (part / (1 - part))
        taken, words = set(), 0
        for i in sorted(ranks, key=lambda i: (ranks[i], i)):
            words += size[i]
            if words > rest:
                words -= size[i]
                break
            taken.add(i)
        missing = rest - words
        near = [(abs(missing - size[i]), ranks.get(i, math.inf), i) for i in ids if i not in taken and base[i] < most and abs(missing - size[i]) < missing]
        taken |= {min(near)[2]} if near else set()
        copies |= {i: base[i] + (i in taken) for i in ids}
    return copies


def test_small_table_by_brute_force(small):
    rows = [(r.doc_id, r.text, r.source) for r in small.collect()]
    assert {r.doc_id: r.copies for r in M.mix(small).collect()} == brute(rows, lambda size, i: size.bit_length() or 1)


def test_weights_that_bind(spark):
    """Heavy documents reach the most copies; what they leave over goes to the light ones, and targets are met."""
    rng = random.Random(5)
    rows = [(i, "w " * (10 if i < 220 else rng.randint(1, 60)), "ab"[i % 3 == 0] if i < 220 else "cd"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = F.when(F.col("doc_id") % 10 == 0, 50.0).otherwise(1.0)
    got = check(docs, weight=weight)
    assert max(taken / size for _, size, taken in got) == 3
    assert {r.doc_id: r.copies for r in M.mix(docs, weight=weight).collect()} == brute(rows, lambda size, i: 50 if i % 10 == 0 else 1)


def test_rows_without_an_id_are_sampled_by_their_texts(spark):
    """They do not share one random number, which would take the shortest ones first."""
    rows = [(None, f"t{i} " * (1 + i % 40), "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert check(docs) == check(docs.repartition(7))
    some = [(r.size, r.copies) for r in M.mix(docs, weights=(1, 3), weight=F.lit(1.0)).where("source = 'a'").collect()]
    taken, left = [s for s, c in some if c], [s for s, c in some if not c]
    assert taken and left and abs(sum(taken) / len(taken) - sum(left) / len(left)) < 3


def test_repeated_rows_share_out_their_copies(spark):
    """A third of all rows are one row; targets are met all the same, and no row depends on the layout."""
    rows = [(7, "one two three", "a")] * 300 + [(100 + i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = check(docs)
    assert got == check(docs.repartition(5))
    repeated = M.repeat_documents(docs.withColumn("level", F.lit(1)).withColumn("end", F.lit(2)))
    assert repeated.columns == ["doc_id", "text", "source", "level", "end"]
    assert repeated.where("doc_id = 7").count() * 3 == sum(taken for i, _, taken in got if i == "7")


def test_bins_do_not_change_the_result(small):
    assert check(small, bins=4) == check(small)


def test_weights_make_inclusion_unequal(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    got = M.mix(docs, weights=(1, 3), weight=F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(3.0))
    mean = {r.h: r.c for r in got.where("source = 'a'").groupBy((F.col("doc_id") % 4 >= 2).alias("h")).agg(F.avg("copies").alias("c")).collect()}
    assert mean[True] / mean[False] == pytest.approx(3, rel=0.25)


def test_empty_table(no_docs):
    assert M.op4(no_docs).count() == 0


def test_documents_are_repeated(edge_docs):
    got = M.repeat_documents(edge_docs)
    assert got.columns == edge_docs.columns
    want = {r.k: r.c for r in M.mix(edge_docs).groupBy(F.coalesce("doc_id", F.lit(0)).alias("k")).agg(F.sum("copies").alias("c")).collect() if r.c}
    assert {r.k: r["count"] for r in got.groupBy(F.coalesce("doc_id", F.lit(0)).alias("k")).count().collect()} == want
