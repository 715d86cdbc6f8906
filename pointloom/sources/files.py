"""Paths and listings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def resolve(path: str, root: str) -> str:
    """``path`` itself if it is absolute or names a file system, else below ``root``."""
    return path if os.path.isabs(path) or "://" in path else f"{root.rstrip('/')}/{path}"


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, length) of the files that match a glob, through Spark's readers, without their contents."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return files.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("name"), "length")
