from pyspark.sql import functions as F

import corpus_pipeline as P
from pointloom.llm import line_dedup, mixing, quality_rules

from test_shingle_join import brute as all_pairs

SF = "/root/testdata/sf0.001"


def _ids(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_stages_in_order(spark, small, tmp_path):
    """Each stage against its operator on what the stage before kept."""
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "source mix", "bpe"]
    outs, docs = [], small
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, "/root/testdata/sf0.01").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        outs.append(docs)
    assert all(o.columns == list(P.COLUMNS) for o in outs[:-1])
    kept = quality_rules.op9(small).where("kept").select("doc_id")
    assert _ids(outs[0]) == _ids(small.join(kept, "doc_id", "left_semi"))
    lines = line_dedup.dedup_lines(outs[0])
    assert _ids(outs[1]) == sorted((str(r.doc_id), r.kept_text) for r in lines.collect())
    # The stage links by five words and a similarity of 0.8, not by op7's contract of three words and two bits.
    assert sorted(r.doc_id for r in outs[2].collect()) == all_pairs([(r.doc_id, r.text) for r in outs[1].collect()])
    copies = {r.doc_id: r.copies for r in mixing.mix(outs[2]).collect()}
    assert outs[3].count() == sum(copies.values())
    assert outs[4].count() == outs[3].count()


def test_edge_cases_and_empty_tables(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in P.STAGES:
            got = stage(spark, docs, "")
            assert got.count() <= 3 * docs.count(), name


def test_one_of_several_rows_with_an_id_stays(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, "one two three four five"), (None, "x")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "null as lang", "null as source", "1L as n_chars")
    assert sorted(str(r.doc_id) for r in P.near_duplicates(spark, docs, "").collect()) == ["1", "None"]


def test_run_is_the_chain_of_its_stages_and_reads_documents_once(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    rows = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def quality(spark, docs, sf_dir, stage=P.quality):
        return stage(spark, docs.mapInArrow(counted, docs.schema), sf_dir)

    monkeypatch.setattr(P, "STAGES", [(P.STAGES[0][0], quality), *P.STAGES[1:]])
    assert rows(P.run(spark, SF)) == rows(docs)
    assert read.value == n


def test_run_leaves_one_table_behind(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert P.run(spark, SF).count() > 0
        left = [p for p in tmp_path.glob("*/*") if any(p.rglob("part-*"))]
        assert len(left) == 1
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before.rsplit("/", 1)[0])


def test_other_columns_are_carried_along_and_few_are_needed(spark, small):
    for docs in (small.withColumn("row", F.lit(1)).withColumn("end", F.lit("x")), small.select("doc_id", "text", "source")):
        out = docs
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, out.limit(60), "")
            assert out.columns == docs.columns, name
        assert P.tokens(spark, out, "").count() == out.count()
