import hashlib

import pytest

from pointloom.llm import line_dedup as L
from pointloom.llm.common import LOWER, SPACE, UPPER


def brute(rows):
    key = lambda line: line.strip(SPACE).translate(str.maketrans(UPPER, LOWER))
    order = lambda i: -(10**18) if i is None else i
    docs = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 20:
                docs.setdefault(key(line), set()).add(order(r.doc_id))
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        keep = [x for x in lines if not (len(docs.get(key(x), ())) >= 3 and order(r.doc_id) != max(docs[key(x)]))]
        out.append((r.doc_id, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(params=["hot", "light", "mixed"])
def share(request, monkeypatch):
    """All keys as hot ones, none, or those with over a twentieth of the lines."""
    monkeypatch.setattr(L, "HOT_SHARE", {"hot": 10**9, "light": 0, "mixed": 20}[request.param])


def test_edge_cases(share, edge_docs):
    assert sorted(map(tuple, L.op8(edge_docs).collect()), key=str) == brute(edge_docs.collect())


def test_small_table(share, small):
    assert sorted(map(tuple, L.op8(small).collect()), key=str) == brute(small.collect())


def test_a_line_repeated_within_one_document_is_kept(share, spark):
    line = "a line that is surely long enough"
    docs = spark.createDataFrame([(1, "\n".join([line] * 5)), (2, line), (3, "other")], "doc_id long, text string")
    assert sum(r.n_dropped for r in L.op8(docs).collect()) == 0


def test_empty_table(no_docs):
    assert L.op8(no_docs).count() == 0


def test_extra_columns_are_carried(edge_docs):
    got = L.dedup_lines(edge_docs, extra=("key", "t", "size"))
    assert {"key", "t", "size", "kept_text"} <= set(got.columns) and got.count() == edge_docs.count()
