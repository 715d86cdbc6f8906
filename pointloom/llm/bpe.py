"""BPE encoding and decoding: backtracking encoder, offset-table decoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.common import map_arrow, texts
from pointloom.llm.vocab import CACHE_LETTERS, CACHE_PIECES, BacktrackingEncoder, OffsetDecoder, Splitter, load, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"


class _Encoded(dict):
    """Piece -> its ids as little-endian bytes; a bounded number of short pieces is kept."""

    def __init__(self, encoder: BacktrackingEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= CACHE_LETTERS and len(self) < CACHE_PIECES:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts exactly as the vocabulary's library does."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        self.cache = _Encoded(BacktrackingEncoder(path))
        self.special = {s: np.array([i], dtype="<u4").tobytes() for s, i in load(path).special.items()}
        self.decoder = OffsetDecoder(path)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces, special = self.split.pieces(text)
        if special:
            own = self.special
            return b"".join([own.get(p) or self.cache[p] for p in pieces])
        return b"".join(map(self.cache.__getitem__, pieces))

    def decode(self, ids: bytes) -> str:
        return self.decoder.decode(np.frombuffer(ids, dtype="<u4")).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (binary: little-endian unsigned 32-bit ids) of every whole text.

    A null text encodes as the empty text, to no ids. Every input row gives one row,
    repeated rows and null ids too. No shuffle; memory is one Arrow batch and a
    bounded cache, whatever the input's size.
    """

    def make():
        c = codec(path)
        return lambda b: {"doc_id": b.column(0), "ids": [c.encode(t) for t in b.column(1).to_pylist()]}

    return map_arrow(texts(docs), "doc_id long, ids binary", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of rows with ``ids`` as ``encode`` gives them; null ids decode to the empty text."""

    def make():
        c = codec(path)
        return lambda b: {"doc_id": b.column(0), "text": [c.decode(i or b"") for i in b.column(1).to_pylist()]}

    return map_arrow(encoded.select("doc_id", "ids"), "doc_id long, text string", make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row the token count and the digests of its ids and of the text decoded from them, in one pass.

    A null text encodes as the empty text, to no ids, and decodes to it. Null ids and repeated
    rows are encoded like any other; an empty table gives no rows. No shuffle.
    """

    def make():
        c = codec(path)

        def step(batch) -> dict:
            rows = [_digest(c, t) for t in _released(batch.column(1).to_pylist())]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        step.close = c.cache.clear
        return step

    return map_arrow(texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row its id, source, language, ids (binary) and their number, with the digests that ``digests`` gives.

    A null text encodes as the empty text, to no ids. A table without source or language has
    null there. Null ids and repeated rows are encoded like any other; an empty table gives no rows.
    """

    def make():
        c = codec(path)

        def step(batch: pa.RecordBatch) -> dict:
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "lang": batch.column(2),
                "source": batch.column(3),
                "n_tokens": [len(i) // 4 for i in ids],
                "ids": ids,
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(c.decode(i).encode()).hexdigest() for i in ids],
            }

        step.close = c.cache.clear
        return step

    schema = "doc_id long, lang string, source string, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
    more = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return map_arrow(texts(docs, *more), schema, make)


def _released(items: list) -> Iterator[str]:
    """The items in order, each let go once it is used."""
    items.reverse()
    while items:
        yield items.pop()


def _digest(c: Codec, text: str) -> tuple[int, str, str]:
    ids = c.encode(text)
    decoded = c.decode(ids).encode()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op1(docs: DataFrame) -> DataFrame:
    return digests(docs, vocabulary_path(VOCABULARY))
