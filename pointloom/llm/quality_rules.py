"""Quality rules: text statistics and zstandard compression bands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointloom.llm.common import SPACE_BYTES, map_arrow, release, sliced, small_batches, texts

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

CHUNK_BYTES = 1 << 14
LEVEL = 3


@dataclass(frozen=True)
class Band:
    """Limits of bytes over compressed bytes for texts or chunks of at least ``from_bytes`` bytes."""

    from_bytes: int
    low: float
    high: float


#: By length, as longer texts compress better: below ``low`` a text is noise, above ``high`` it repeats itself.
#: Prose of labelled texts begins at 1.15 (180 bytes), 1.24 (256), 1.34 (350), 1.45 (512), 1.51 (700), 1.66 (1,024), 1.82
#: (2,048) and ends at 2.9 (100,000 bytes); random base64 in words ends at 1.13, 1.15, 1.23, 1.26, 1.31, 1.33 and 1.36.
#: Below 180 bytes the two overlap.
BANDS = (
    Band(0, 0.0, 2.8),
    Band(180, 1.13, 2.8),
    Band(256, 1.17, 2.8),
    Band(350, 1.25, 2.8),
    Band(512, 1.32, 2.8),
    Band(700, 1.38, 2.8),
    Band(1024, 1.42, 2.9),
    Band(1400, 1.44, 2.9),
    Band(2048, 1.45, 3.0),
    Band(8192, 1.5, 3.3),
    Band(65536, 1.5, 3.8),
)


def band(size: int, bands: tuple[Band, ...] = BANDS) -> Band:
    return next(b for b in reversed(bands) if size >= b.from_bytes)


class CompressionBands:
    """Rejects a text whose ratio, or that of one of its fixed chunks, is outside the band of its length."""

    def __init__(self, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level)
        self.bands, self.chunk_bytes = bands, chunk_bytes

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compressor.compress(data))

    def judge(self, data: bytes) -> tuple[float, float, float, bool]:
        """Ratio of the whole, least and greatest ratio of its chunks, and whether all are within their bands."""
        if not data:
            return 0.0, 0.0, 0.0, False
        whole = self.ratio(data)
        if len(data) <= self.chunk_bytes:
            parts = [(whole, len(data))]
        else:
            cuts = range(0, len(data), self.chunk_bytes)
            parts = [(self.ratio(p), len(p)) for p in (data[i : i + self.chunk_bytes] for i in cuts)]
        within = all(b.low <= r <= b.high for r, b in ((r, band(n, self.bands)) for r, n in [(whole, len(data)), *parts]))
        return whole, min(parts)[0], max(parts)[0], within


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """How many words lie in a window of ``window`` words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    fresh = count()
    ids = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(fresh)) for w in words), dtype=np.int64, count=len(words))
    # Number the distinct windows of 1, 2, 4, ... words: a window is a pair of windows of half its size.
    ranks, size = ids, 1
    while size < window:
        step = min(size, window - size)
        pairs = ranks[: len(words) - size - step + 1] * (int(ranks.max()) + 1) + ranks[step : len(words) - size + 1]
        ordered = np.sort(pairs)
        if not (ordered[1:] == ordered[:-1]).any():
            return 0  # windows that differ keep differing as they grow
        ranks = np.unique(pairs, return_inverse=True)[1]
        size += step
    twice = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges)[: len(words)] > 0).sum())


def statistics(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = data.split()
    letters = data.translate(None, SPACE_BYTES)
    # Of the bytes of a character only the first is not a continuation byte.
    chars = len(letters) - len(letters.translate(None, bytes(b for b in range(256) if not 0x80 <= b < 0xC0)))
    lines = [line for line in data.split(b"\n") if line.strip(SPACE_BYTES)]
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _judged(rules: CompressionBands, text: str) -> tuple:
    """The statistics, base_failed, kept and the ratios of one text."""
    data = text.encode()
    stats = statistics(data)
    failed = stats[0] < MIN_WORDS or 100 * stats[4] > MAX_REPEATED_PERCENT * stats[0]
    whole, least, greatest, within = rules.judge(data)
    return *stats, failed, within and not failed, whole, least, greatest


_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, greatest_chunk_ratio double"
)


def judge(docs: DataFrame, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """One row per input row: the statistics of the whole text, base_failed, kept and the compression ratios.

    ``kept`` is false where the base rules fail, else whether the text and each of its
    chunks lie within their compression bands. A null or empty text has no words and
    fails. Null ids and repeated rows are judged like any other row; an empty table
    gives an empty result. No shuffle.
    """

    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def make():
        rules = CompressionBands(bands, chunk_bytes, level)

        def step(batch: pa.RecordBatch) -> dict:
            rows = [_judged(rules, t) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * (len(names) - 1)
            return {"doc_id": batch.column(0)} | dict(zip(names[1:], columns, strict=True))

        return step

    return map_arrow(texts(docs), _SCHEMA, make)


def filter_documents(docs: DataFrame, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = CompressionBands(bands, chunk_bytes, level)
        for batch in sliced(batches):
            verdicts = [_judged(rules, t or "")[6] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(verdicts, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def op9(docs: DataFrame) -> DataFrame:
    return judge(docs)
