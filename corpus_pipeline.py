"""A corpus pipeline over the document operators.

Each stage works on all rows that the one before it kept and reads doc_id, text, lang and
source, and n_chars where there is one; all other columns of a document are carried along
up to the last stage. Rows are told apart as rows, whatever their ids: null and repeated
ids are kept or dropped like any other. An empty table passes through every stage, empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import bpe, line_dedup, mixing, quality_rules, shingle_join
from pointloom.llm.vocab import vocabulary_path
from pointloom.plans.lineage import delete, scratch, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, null and empty texts among them."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows. A text that loses every line stays, empty; a null one stays null."""
    return line_dedup.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id, a null one last, of repeated ids the first.

    Texts are linked from a similarity of 0.8 of their five-word shingles: pairs are proposed by
    multi-index hashing of SimHashes and by a prefix filter, and compared by whole sets. Null,
    empty and wordless texts are alike.
    """
    return shingle_join.distinct_rows(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, which may be never."""
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with the digests of the ids and of the text decoded from them. A null text has no ids."""
    return bpe.encode_documents(docs, vocabulary_path(bpe.VOCABULARY))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("source mix", mixture),
    ("bpe", tokens),
]

#: SQL has neither zstandard nor XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.

    Every stage but the last, which is one pass without a shuffle, is written once to the shared
    checkpoint folder; the next one reads it there. What a stage cuts or stores on its way, and
    what the stage before it wrote, is deleted as soon as its own result is written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs, folder = written(stage(spark, docs, sf_dir))
        if last:
            delete(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
