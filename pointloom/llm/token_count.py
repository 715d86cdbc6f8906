"""Token counts: whole tokens are counted directly, the rest is merged."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from pointloom.llm.common import map_arrow, texts
from pointloom.llm.vocab import CACHE_LETTERS, CACHE_PIECES, BacktrackingEncoder, Splitter, vocabulary_path, whole_tokens

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


class _Counts(dict):
    """Piece -> number of tokens, prefilled with every piece proven to be one whole token."""

    def __init__(self, path: str):
        whole = (t.decode("utf-8", errors="ignore") for t in whole_tokens(path) if t)
        super().__init__({piece: 1 for piece in whole if piece.encode() in whole_tokens(path)})
        self.encoder = BacktrackingEncoder(path)
        self.most = len(self) + CACHE_PIECES

    def __missing__(self, piece: str) -> int:
        n = len(self.encoder.encode(piece.encode()))
        if len(piece) <= CACHE_LETTERS and len(self) < self.most:
            self[piece] = n
        return n


class Counter:
    def __init__(self, path: str):
        self.split = Splitter(path)
        self.counts = _Counts(path)

    def count(self, text: str) -> int:
        pieces, special = self.split.pieces(text)
        if special:
            own = self.split.special
            return sum(1 if p in own else self.counts[p] for p in pieces)
        return sum(map(self.counts.__getitem__, pieces))


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens and whether those exceed ``limit``, of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Every input row gives one row, null ids and
    repeated rows too; an empty table gives no rows. No shuffle.
    """

    def make():
        c = counter(path)

        def step(batch) -> dict:
            rows = batch.column(1).to_pylist()
            n = [c.count(t) for t in rows]
            sizes = [len(t.encode()) for t in rows]
            return {"doc_id": batch.column(0), "n_bytes": sizes, "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_arrow(texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)


def op10(docs: DataFrame) -> DataFrame:
    return count_tokens(docs, vocabulary_path(VOCABULARY))
