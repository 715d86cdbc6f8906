"""The queries of this subpackage, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import bpe, exact_dedup, line_dedup, maxent_lm, mixing, quality_fm, quality_rules, simhash, token_count, toxicity
from pointloom.llm.common import table


def _over_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_codec": _over_documents(bpe.op1),
        "op2_quality_fm": quality_fm.op2,
        "op3_maxent_lm": _over_documents(maxent_lm.op3),
        "op4_source_mix": _over_documents(mixing.op4),
        "op5_exact_dedup": _over_documents(exact_dedup.op5),
        "op6_toxicity_chain": toxicity.op6,
        "op7_simhash_near_dedup": _over_documents(simhash.op7),
        "op8_line_dedup": _over_documents(line_dedup.op8),
        "op9_quality_rules": _over_documents(quality_rules.op9),
        "op10_token_counts": _over_documents(token_count.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mix": mixing.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
    }
