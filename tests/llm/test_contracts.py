import __spark_entry__ as entry

COLUMNS = {
    "op1_bpe_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_quality_fm": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_maxent_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op6_toxicity_chain": {"doc_id": "bigint", "score": "double", "toxic": "boolean"},
    "op7_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op9_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


def test_queries_return_the_columns_agreed_on(spark):
    found = entry.queries()
    assert "pipeline" in found
    for name, want in COLUMNS.items():
        got = dict(found[name](spark, "/root/testdata/sf0.001").dtypes)
        assert want.items() <= got.items(), name


def test_native_operators_run_no_python(spark):
    for name in ("op4_source_mix", "op8_line_dedup"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
