import random

import pytest

import corpus_pipeline as P
from pointloom.llm import shingle_join as J


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """The ids that stay, by comparing all pairs."""
    sets = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for (i, _), g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, i), i)
    return sorted(best.values())


def variants(seed):
    """Texts of many lengths with copies that have some words replaced, and one text in many copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(2000)}"
    texts = []
    for n in [3, 4, 5, 6, 8, 12, 30, 60, 120, 400]:
        for _ in range(3):
            base = [word() for _ in range(n)]
            texts.append(base)
            for changes in (0, 1, 1, 2, 3, 5, 8):
                new = list(base)
                for _ in range(changes):
                    new[rng.randrange(n)] = word()
                texts.append(new)
    base = [word() for _ in range(80)]
    texts += [[*base[:k], word(), *base[k + 1 :]] for k in range(80)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bits", [4, 20])
def test_all_similar_pairs_are_found(spark, bits):
    rows = variants(bits)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sketch = 8 if bits == 4 else bits
    got = J.distinct_rows(docs, sketch_bits=sketch, table_bits=max(bits, 6)).collect()
    assert sorted(r.doc_id for r in got) == brute(rows)


def test_the_stage_finds_what_is_five_bits_apart(spark):
    words = [f"w{i}" for i in range(100)]
    other = [*words[:50], "another", *words[51:]]
    less = [*words[:20], "a", *words[21:40], "b", *words[41:60], "c", *words[61:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(less)), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "null as lang", "null as source", "1L as n_chars")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == brute(rows) == [1, 3, 4]


def test_repeated_and_null_ids_neither_lose_texts_nor_keep_copies(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (1, two), (2, one), (None, two), (None, three), (None, three), (3, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("doc_id", "text", "null as lang", "null as source", "1L as n_chars")
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, one), (1, two), (None, three)], key=str)


def test_many_texts_of_one_pattern_do_not_meet_in_pairs(spark, monkeypatch):
    """Near the limit of similarity few of many changed copies are similar; the result is that of all pairs."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        new = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            new[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(new)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared, similar = [], J._similar
    monkeypatch.setattr(J, "_similar", lambda rows, pairs, words: compared.append(pairs.count()) or similar(rows, pairs, words))
    assert sorted(r.doc_id for r in J.distinct_rows(docs).collect()) == brute(rows)
    assert sum(compared) < 120 * 119 / 2 / 3


def test_marks_differ_no_more_than_sets():
    rng = random.Random(3)
    for _ in range(200):
        a = J.shingles(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 400))))
        b = J.np.unique(J.np.concatenate([a[rng.randrange(len(a)) :], J.shingles(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))))]))
        bits = sum(int(x ^ y).bit_count() for x, y in zip(J._marks(a).view(J.np.uint64).tolist(), J._marks(b).view(J.np.uint64).tolist()))
        assert bits <= len(J.np.setxor1d(a, b))
