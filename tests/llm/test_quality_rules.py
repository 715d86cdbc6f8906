import base64
import random
import re

import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from pointloom.llm import quality_rules as Q
from pointloom.llm.common import SPACE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", " ", "　x", "a\tb"]), max_size=60).map(" ".join))
def test_statistics(text):
    assert Q.statistics(text.encode()) == plain(text)


@pytest.mark.parametrize("window", [2, 3, 5, 8])
def test_windows_of_any_size(window):
    rng = random.Random(window)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(200)]
    at = {}
    for i in range(len(words) - window + 1):
        at.setdefault(tuple(words[i : i + window]), []).append(i)
    want = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(window)}
    assert Q.repeated_words(words, window) == len(want)


def test_bands_reject_repetition_and_noise_only():
    rules = Q.CompressionBands()
    rng = random.Random(0)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "en", "i", "or", "u")]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(3000)).encode()
    noise = base64.b64encode(rng.randbytes(9000))
    assert rules.judge(prose)[3]
    assert not rules.judge(b"the same words again and again. " * 300)[3]
    assert not rules.judge(noise)[3]
    # One bad chunk is enough, even where the whole is within its band.
    mixed = prose[: 1 << 14] + noise[: 1 << 14] + prose
    whole = Q.band(len(mixed))
    assert whole.low <= rules.ratio(mixed) <= whole.high and not rules.judge(mixed)[3]
    assert len(prose) / len(zstandard.ZstdCompressor(level=Q.LEVEL).compress(prose)) == rules.ratio(prose)


def check(docs):
    rows = docs.collect()
    rules = Q.CompressionBands()
    want = []
    for r in rows:
        text = r.text or ""
        stats = plain(text)
        failed = stats[0] < 20 or 100 * stats[4] > 30 * stats[0]
        want.append((r.doc_id, *stats, failed, not failed and rules.judge(text.encode())[3]))
    assert sorted((tuple(r)[:8] for r in Q.op9(docs).collect()), key=str) == sorted(want, key=str)
    kept = sorted(str((r.doc_id, r.text)) for r in Q.filter_documents(docs).collect())
    assert kept == sorted(str((r.doc_id, r.text)) for r, w in zip(rows, want) if w[-1])


def test_edge_cases(edge_docs):
    check(edge_docs)
    assert Q.filter_documents(edge_docs).schema == edge_docs.schema


def test_small_table(small):
    check(small)


def test_good_documents_stay(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = Q.op9(small).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert got.where("not kept").count() == 0


def test_empty_table(no_docs):
    assert Q.op9(no_docs).count() == 0 and Q.filter_documents(no_docs).count() == 0


def test_noise_of_every_length_is_rejected_and_prose_is_kept(spark):
    """Random base64 in words, and labelled clean texts."""
    import string

    rng, rules = random.Random(1), Q.CompressionBands()
    letters = string.ascii_letters + string.digits + "+/"
    for size in (220, 300, 400, 600, 900, 1200, 1700, 3000, 6000, 20_000):
        for _ in range(20):
            words = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) for _ in range(size // 5))[:size]
            assert not rules.judge(words.encode())[3], size
    sf = "/root/testdata/sf0.1"
    clean = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    judged = [(r.base_failed, r.kept) for r in Q.judge(clean).collect()]
    assert sum(kept for failed, kept in judged if not failed) >= 0.998 * sum(not failed for failed, _ in judged)
