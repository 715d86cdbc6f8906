import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import simhash as S
from pointloom.llm.common import LOWER, UPPER


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(pairs, distance=2):
    """(doc_id, fingerprint) -> component id by comparing all pairs."""
    fps = sorted({fp for _, fp in pairs})
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = {}
    for i, fp in pairs:
        if i is not None:
            least[find(fp)] = min(least.get(find(fp), i), i)
    return {(i, f"{fp:016x}"): least.get(find(fp)) for i, fp in pairs}


def check(docs, **how):
    pairs = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    got = S.near_duplicates(docs, **how).collect()
    assert len(got) == len(pairs)
    want = brute(pairs)
    for r in got:
        assert want[r.doc_id, r.fingerprint] == r.component_id


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_small_table(small):
    check(small)


def test_crowded_keys_lose_no_link(small):
    check(small, crowded=1)


def test_empty_table(no_docs):
    assert S.op7(no_docs).count() == 0


def test_odd_distances_are_refused(edge_docs):
    with pytest.raises(ValueError):
        S.near_duplicates(edge_docs, max_distance=3)


@pytest.mark.parametrize("crowded", [1, 4, 10_000])
@pytest.mark.parametrize(("distance", "segments"), [(2, 2), (2, 3), (4, 2), (0, 1)])
def test_links_join_what_brute_force_joins(spark, crowded, distance, segments):
    import random

    rng = random.Random(distance * 10 + segments)
    values = [rng.getrandbits(64) for _ in range(6)]
    for v in list(values):
        for _ in range(25):
            w = v
            for _ in range(rng.randint(1, distance + 2)):
                w ^= 1 << rng.choice([rng.randrange(64), rng.randrange(8)])
            values.append(w)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(values)]
    nodes = spark.createDataFrame(signed, "fp long")
    links = S.hamming_links(nodes, distance, segments, crowded)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > distance).count() == 0
    from pointloom.operators.graph import connected_components

    got = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in connected_components(links, "a", "b").collect()}
    want = brute([(v, v) for v in set(values)], distance)
    groups = {}
    for (v, _), c in want.items():
        groups.setdefault(c, set()).add(got.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
