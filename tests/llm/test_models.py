import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pointloom.llm import maxent_lm as L, quality_fm as Q, toxicity as T

SF = "/root/testdata/sf0.1"


def held(i, modulus, remainder):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == remainder


def test_pairwise_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    n = Q.WORD_FEATURES + Q.STRUCTURE
    m = Q.Machine(0.3, rng.normal(0, 0.1, n), rng.normal(0, 0.1, (n, Q.FACTORS)), np.zeros(Q.STRUCTURE), np.ones(Q.STRUCTURE))
    ids, values, shape = np.array([3, 9, 70], np.int32), np.array([0.5, 0.2, 0.1], np.float32), list(rng.normal(0, 1, Q.STRUCTURE))
    x = dict(zip(ids.tolist(), values.tolist())) | {Q.WORD_FEATURES + i: s for i, s in enumerate(np.clip(shape, -4, 4))}
    z = m.bias + sum(m.weights[i] * v for i, v in x.items())
    z += sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in x for j in x if i < j)
    assert m.score(ids, values, shape) == pytest.approx(1 / (1 + math.exp(-z)))


def test_machine_learns_an_interaction():
    """Whether two features come together, which no linear model can tell."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        ids = np.array([5 if a else 6, 17 if b else 18], np.int32)
        rows.append((ids, np.ones(2, np.float32), np.zeros(Q.STRUCTURE)))
        labels.append(float(a == b))
    m = Q.fit(rows, np.array(labels), epochs=60)
    assert np.mean([(m.score(i, v, s) >= 0.5) == y for (i, v, s), y in zip(rows, labels)]) > 0.95


def test_quality_of_held_out_rows(spark):
    got = Q.op2(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert (got[got.quality == 1].predicted == 1).mean() > 0.99


def test_quality_edge_cases(spark, edge_docs, no_docs):
    machine = Q._untrained()
    got = Q.score(edge_docs, machine).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1), (3, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert Q.score(no_docs, Q.train(edge_docs, labels)).count() == 0
    assert Q.score(edge_docs, Q.train(edge_docs, labels.limit(0))).count() == edge_docs.count()


def test_quality_scores_by_brute_force(spark, small):
    """Every score of the query from its own machine: words hashed one by one, all pairs of features multiplied out."""
    from xxhash import xxh32_intdigest

    sf = "/root/testdata/sf0.01"
    m = Q.train(small, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in Q.op2(spark, sf).collect()}
    assert len(got) == small.count()
    for r in small.where("doc_id % 9 = 0").collect():
        words = (r.text or "").lower().split()
        counts = Counter(xxh32_intdigest(w, 7) % Q.WORD_FEATURES for w in words)
        damped = {k: math.log1p(v) for k, v in counts.items()}
        size = max(math.sqrt(sum(v * v for v in damped.values())), 1e-9)
        x = {k: v / size for k, v in damped.items()}
        shape = Q.structure((r.text or "").encode(), words, r.n_chars)
        x |= {Q.WORD_FEATURES + i: min(max((s - m.mean[i]) / m.scale[i], -4), 4) for i, s in enumerate(shape)}
        at, values = list(x), np.array(list(x.values()))
        products = (m.factors[at] @ m.factors[at].T) * np.outer(values, values)
        z = m.bias + m.weights[at] @ values + np.triu(products, 1).sum()
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))), abs=1e-5)
        assert got[r.doc_id].held_out == held(r.doc_id, 3, 1) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_quality_without_recorded_lengths(spark, edge_docs):
    got = Q.score(edge_docs.drop("n_chars"), Q._untrained()).collect()
    assert len(got) == edge_docs.count()


def test_toxicity_scores_by_brute_force(spark, small):
    """Every score of the query from its own chain: features of each word by their strings, category after category."""
    from xxhash import xxh32_intdigest

    sf = "/root/testdata/sf0.01"
    chain = T.train(small, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in T.op6(spark, sf).collect()}
    assert len(got) == small.count()
    for r in small.where("doc_id % 9 = 0").collect():
        seen = Counter()
        for word in {w.strip(T._EDGES) for w in (r.text or "").lower().split()} - {""}:
            keys = ["w" + word] + [f"{k}{word[:k]}" for k in T.BEGINNINGS if len(word) > k]
            seen.update(xxh32_intdigest(k, 11) % T.HASHES for k in keys)
        found = set(seen) | {h + T.HASHES for h, n in seen.items() if n > 1}
        p = []
        for k in range(len(chain.biases)):
            z = chain.biases[k] + sum(chain.weights[k, c] for h, c in chain.columns.items() if h in found) + sum(chain.earlier[k, j] * p[j] for j in range(k))
            p.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        assert got[r.doc_id].score == pytest.approx(p[-1], abs=1e-9) and got[r.doc_id].toxic == (p[-1] >= 0.5)


def test_toxicity_of_held_out_rows(spark):
    got = T.op6(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("toxic", "y"), "doc_id").where("held_out").toPandas()
    assert got[got.y == 1].toxic.mean() > 0.85
    assert got[got.y == 0].toxic.mean() < 0.01


def _toy(n=300, seed=2):
    """Rows of 5 of 20 features; toxic with the features 3 or 4, of which 3 is a kind of its own."""
    rng = np.random.default_rng(seed)
    found = [np.array(sorted(rng.choice(20, 5, replace=False)), np.int32) for _ in range(n)]
    return found, np.array([int(3 in f or 4 in f) for f in found]), np.arange(n) % T.FOLDS


def test_chain_uses_earlier_categories():
    """The second kind is told by the first one's features alone, and toxicity needs both."""
    found, toxic, folds = _toy()
    two = lambda rows, y, width: np.array([[3 in f and t, (3 in f) != (4 in f) and t] for f, t in zip(rows, y)])
    chain = T.fit(found, toxic, folds, lambda some: {i: i for i in range(20)}, two)
    assert np.abs(np.triu(chain.earlier)).sum() == 0 and np.abs(chain.earlier[1, 0]) > 0 and np.abs(chain.earlier[2, :2]).sum() > 0
    assert np.mean([round(chain.predict(f)[-1]) == t for f, t in zip(found, toxic)]) > 0.95


def test_out_of_fold_predictions_have_not_seen_their_labels(spark, monkeypatch):
    """Whatever the labels of a fold, the chains that predict it, their features and their kinds are the same."""
    found, toxic, folds = _toy()
    schema = "doc_id long, found binary, toxic int, fold int"
    fitted = []
    for flip in (False, True):
        y = np.where((folds == 1) & flip, 1 - toxic, toxic)
        read = spark.createDataFrame([(i, f.tobytes(), int(t), int(k)) for i, (f, t, k) in enumerate(zip(found, y, folds))], schema)
        columns, made = T._select(read, 8), {}
        chain_of = T.Chain
        monkeypatch.setattr(T, "Chain", lambda c, *rest: made.setdefault(len(made), chain_of(c, *rest)))
        T.fit(found, y, folds, columns.__getitem__)
        monkeypatch.setattr(T, "Chain", chain_of)
        fitted.append((columns, [[c.predict(np.array([c.columns[h] for h in f.tolist() if h in c.columns], np.int32)) for f in found] for c in made.values()]))
    without = [s for s in T._subsets() if 1 not in s]
    assert all(fitted[0][0][s] == fitted[1][0][s] for s in without) and fitted[0][0][0, 1, 2] != fitted[1][0][0, 1, 2]
    same = sum(any(a == b for b in fitted[1][1]) for a in fitted[0][1])
    assert same == len(without)


def test_kinds_are_the_blocks_of_features():
    rows = [np.array([0, 1, 2], np.int32)] * 5 + [np.array([7, 8], np.int32)] * 3 + [np.array([12], np.int32)] * 2 + [np.array([1, 8], np.int32), np.zeros(0, np.int32)]
    got = T.kinds_of(rows, np.array([1] * 10 + [0, 1]), 15)
    assert got[:5, 0].all() and got[5:8, 1].all() and got[8:10, 2].all() and got.sum() == 10


def test_toxicity_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (3, 0, 1), (3, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    chain = T.train(edge_docs, labels)
    got = T.score(edge_docs, chain).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 and r.toxic == (r.score >= 0.5) for r in got)
    assert T.score(no_docs, chain).count() == 0
    assert T.score(edge_docs, T.train(edge_docs, labels.limit(0))).count() == edge_docs.count()


def check_base(docs, **how):
    rows = docs.collect()
    toks = [L.words_of(r.text or "") + ["\n"] for r in rows]
    c = Counter(w for r, t in zip(rows, toks) if not held(r.doc_id, 7, 2) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), held(r.doc_id, 7, 2), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, toks))
    got = L.score(docs, **how).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


def test_language_model_base_scores(edge_docs, small):
    check_base(edge_docs, block_bytes=64)
    check_base(small)


def test_language_model_learns_word_order(spark):
    """Of two words that are equally frequent the one that follows depends on the word before."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(400):
        words, w = [], 0
        for _ in range(120):
            w = (w * 3 + 1 + int(rng.random() < 0.1)) % 50
            words.append(f"w{w}")
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r for r in check_base(docs) if r.held_out]
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > 0.6 * sum(r.base_score for r in got) / sum(r.n_tokens for r in got)


def _model(seed=4):
    """A model of random weights over a few tokens, some of which share a unit."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}".encode() for i in range(40)] + [b"\n"]
    keys = np.unique(np.array([L.key_of(w) for w in words], np.uint64))
    counts = rng.integers(1, 50, len(keys))
    units = L.Units(np.sort(keys[:15]), np.zeros(L.UNITS, np.int64), np.zeros(L.UNITS, np.int64))
    np.add.at(units.n, units.of(keys), counts)
    np.add.at(units.types, units.of(keys), 1)
    classes = rng.integers(0, L.CLASSES, L.UNITS)
    of_class = L._normal(rng.normal(0, 1, (L.UNITS + 1, L.CLASSES + 1, L.CLASSES)))
    used = np.bincount(classes, minlength=L.CLASSES) > 0
    assert used.all()
    bias, follow = rng.normal(0, 1, L.UNITS), rng.poisson(0.01, (3, L.UNITS)).astype(float)
    bias[15 : L.OWN_UNITS], follow[:, 15 : L.OWN_UNITS] = -40, 0  # no token has these units
    of_unit = L.unit_weights(follow, bias, classes)
    return L.Model(units, classes, of_class, np.tile(of_unit, (L.UNITS // 3 + 1, 1))[: L.UNITS + 1], int(counts.sum()), len(keys)), keys, counts


def test_probabilities_of_all_tokens_add_up():
    """After any two tokens: the known tokens, one unseen one a shared unit, and all followers of the last one."""
    m, keys, counts = _model()
    unseen = np.array([slot for slot in range(1 << L.SUFFIX_BITS)], np.uint64) | np.uint64(1 << 40)
    every = np.unique(np.concatenate([keys, unseen]))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, keys)] = counts
    for i, (two, one) in enumerate([(3, 7), (20, 30), (5, 5)]):
        context = np.searchsorted(every, keys[[two, one]])
        ids = np.concatenate([[*context, t] for t in range(len(every))]).astype(np.int32)
        block = L.Block(ids, every, np.full(len(every), 3))
        follow = np.zeros(len(every))
        follow[np.searchsorted(every, np.random.default_rng(i).choice(keys, int(counts[one])))] += 0
        np.add.at(follow, np.searchsorted(every, np.random.default_rng(i).choice(keys, int(counts[one]))), 1)
        pairs = np.zeros(len(ids))
        pairs[2::3] = follow
        assert (10 ** L.log10_tokens(m, block, n, pairs)[2::3]).sum() == pytest.approx(1, abs=1e-5)


def test_weights_reach_the_prior_optimum():
    """Gradient of the likelihood and prior is zero: counts less expected counts are the prior times the weight."""
    rng = np.random.default_rng(6)
    classes = rng.integers(0, L.CLASSES, L.UNITS)
    bias = rng.normal(0, 1, L.UNITS)
    counts = np.zeros((2, L.UNITS))
    counts[0, rng.choice(L.UNITS, 60)] = rng.integers(1, 400, 60)
    logs = L.unit_weights(counts, bias, classes)
    total = np.stack([np.bincount(classes, weights=c, minlength=L.CLASSES)[classes] for c in counts])
    weights = logs - bias  # up to a constant a class, which the units without counts show
    for k in range(L.CLASSES):
        free = (classes == k) & (counts[0] == 0)
        weights[0, classes == k] -= weights[0, free].mean()
    seen = counts[0] > 0
    assert np.abs(counts - total * np.exp(logs) - L.PRIOR * weights)[0, seen].max() < 0.05 * counts.max()


def test_scores_do_not_depend_on_the_layout(small):
    docs = small.limit(400).cache()
    got = [sorted((r.doc_id, r.n_tokens, r.score, r.base_score) for r in L.score(docs.repartition(k), block_bytes=b).collect()) for k, b in ((2, 1 << 24), (8, 1 << 14))]
    assert [r[:2] for r in got[0]] == [r[:2] for r in got[1]]
    assert np.allclose([r[2:] for r in got[0]], [r[2:] for r in got[1]], rtol=1e-9, atol=0)


def test_scores_by_brute_force(spark):
    """Every token's probability from plain counts of tokens and pairs, and the model's tables."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 40)) % 90) for _ in range(150)] + ["", None, "unheard words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m, *_ = L.train(docs)
    toks = {i: L.words_of(t or "") + ["\n"] for i, t in enumerate(texts)}
    learnt = [t for i, t in toks.items() if not held(i, 7, 2)]
    c, pairs = Counter(w for t in learnt for w in t), Counter(p for t in learnt for p in zip([None, *t], t))
    unit = {w: int(m.units.of(np.array([L.key_of(w.encode())], np.uint64))[0]) for t in toks.values() for w in t}
    own = {w for w in unit if unit[w] < len(m.units.own)}
    n, types = Counter(), Counter()
    for w, k in c.items():
        n[unit[w]] += k
        types[unit[w]] += 1
    for r in L.score(docs).collect():
        total, one, two = 0.0, None, None
        for w in toks[r.doc_id]:
            u = unit[w]
            second = m.classes[unit[two]] if two else L.CLASSES
            before = unit[one] if one else L.UNITS
            q = math.exp(m.of_class[before, second, m.classes[u]] + m.of_unit[before, u])
            q *= 1 if w in own else (c[w] + 1) / (n[u] + types[u] + 1)
            seen = c[one] if one else len(learnt)
            k = L.STRENGTH * seen**L.GROWTH if seen else 1
            total += math.log10(((pairs[one, w] if seen else 0) + k * q) / (seen + k))
            one, two = w, one
        assert r.score == pytest.approx(total, rel=1e-6), r.doc_id


def test_held_out_texts_are_likelier_than_by_bigrams(spark):
    """A plain bigram model with absolute discounting reaches -3.576 a token on these rows, the base score -4.191."""
    got = L.op3(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() / got.n_tokens.sum() > -3.4
    assert got.base_score.sum() / got.n_tokens.sum() == pytest.approx(-4.191, abs=0.001)


def test_empty_language_model(no_docs):
    assert L.op3(no_docs).count() == 0
