import hashlib
import re

import pytest
from hypothesis import given, strategies as st

from pointloom.llm import exact_dedup as X


def brute(rows):
    """By (doc_id, text): expected keep_id, group_size; and the number of kept rows of each group."""
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    out, n = {}, len(groups)
    for body, members in groups.items():
        first = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for r in members:
            out.setdefault((r.doc_id, hashlib.sha256(body.encode()).hexdigest()), (first.doc_id, len(members)))
    return out, n


def check(docs, **how):
    rows = docs.collect()
    want, n_groups = brute(rows)
    got = X.exact_groups(docs, **how).collect()
    assert len(got) == len(rows)
    for r in got:
        assert want[r.doc_id, r.text_sha256] == (r.keep_id, r.group_size)
    assert sum(r.kept for r in got) == n_groups


@given(st.binary(max_size=300), st.integers(1, 50))
def test_fingerprints_compose(data, size):
    whole = (0, 0)
    for part in X.chunks(data, size):
        whole = X.combine(whole, X.fingerprint(part))
    assert whole == X.fingerprint(data)


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_colliding_fingerprints_are_told_apart(edge_docs):
    check(edge_docs, modulus=2)


def test_huge_texts_are_hashed_in_chunks(edge_docs):
    check(edge_docs, huge_chars=30, huge_chunk_chars=7)


def test_a_full_bit_table_only_costs_time(edge_docs):
    check(edge_docs, table_bits=7)


def test_empty_table(no_docs):
    assert X.op5(no_docs).count() == 0


def test_small_table(small):
    check(small)


@pytest.mark.parametrize("texts", [["same text"] * 40, ["a", "b", "c"], [None, "", " "]])
def test_one_group_or_none(spark, texts):
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
