"""What the document operators share: reading tables and mapping Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: The characters that separate words: `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
SLICE_ROWS = 1024
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python in batches of SLICE_ROWS rows, unless the session says otherwise than Spark's default."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(SLICE_ROWS))


def texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, text (null becomes empty) and ``more``, whatever other columns there are."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that few of a batch's texts are Python strings at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def release() -> None:
    """Gives memory that a task has freed back to the system, as the Python worker goes on to other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Map Arrow batches, ``slice_rows`` rows at a time, to columns named as in ``schema``.

    ``make`` runs once a task and returns the function of a batch, which returns a
    dict of equally long lists or arrays. What it builds lives as long as the task, unless
    it takes it from a cache of the Python worker's process; ``close``, if the function has
    such an attribute, is called at the end.
    """
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        step = make()
        for batch in sliced(batches, slice_rows):
            columns = step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
            del columns
        getattr(step, "close", release)()
        release()

    return df.mapInArrow(run, out)
