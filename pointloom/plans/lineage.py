"""Cutting long lineages with files in the cluster's shared folder, and deleting what is no longer read."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Bytes of a row group of stored tables, which a task holds while it writes.
_ROW_GROUP = 1 << 24
#: Files written inside the open ``scratch`` blocks, the innermost last.
_open: list[list[str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; it is deleted with all it holds when the application ends.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a session that
    runs in one process gets a temporary folder of its own where that is unset: on a
    cluster each executor would write to its own disk, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="pointloom-checkpoint-"))
    folder = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes all that is cut or stored in the block when it ends; nothing lazy may outlive it."""
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            delete(spark, folder)


def _noted(folder: str) -> None:
    if _open:
        _open[-1].append(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and return it without its lineage.

    Everything downstream reads the files, so a lost executor costs a re-read and
    columns such as ``monotonically_increasing_id()`` keep the values written.

    A checkpoint keeps the size estimated for its plan. Joins multiply estimates, so over
    the rounds of an iteration they would gain digits without bound; the frame returned
    has the default estimate instead, and adaptive execution goes by the real sizes. No
    public call drops the estimate and keeps the rows in the JVM.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    rows = done.queryExecution().toRdd()
    if _open:
        _noted(done.queryExecution().logical().rdd().getCheckpointFile().get())
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done.schema(), False), spark)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to a folder of its own in the checkpoint folder and read again, and that folder, which no ``scratch`` deletes."""
    spark = df.sparkSession
    void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid4()}"
    plain = df.withColumns({c: F.col(c).cast("string") for c in void})
    plain.write.options(**{"compression": "zstd", "parquet.block.size": _ROW_GROUP}).parquet(folder)
    return spark.read.schema(plain.schema).parquet(folder).withColumns({c: F.lit(None) for c in void}), folder


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, for large tables: in columns and compressed, a fraction of the size of a checkpoint's rows."""
    done, folder = written(df)
    _noted(folder)
    return done
