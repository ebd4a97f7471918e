"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
from sparkloom.llm.decontam import contamination
from sparkloom.llm.near_dedup import near_duplicates


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert 0.5 * at.count() < after.count() if k < 4 else after.select("doc_id").distinct().count() == at.count()
        if name == "near_dedup":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in near_duplicates(at).where("kept").collect()}
        if name == "decontamination":
            gone = {r.doc_id for r in contamination(at, bench).collect()}
            assert gone and {r.doc_id for r in after.collect()} == {r.doc_id for r in at.collect()} - gone
        at = after


def test_odd_documents(spark, docs, empty, sf):
    """Nulls, empty texts and repeated rows pass through all stages."""
    for frame in (docs.unionByName(docs), empty):
        at = frame
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf)
        at.collect()


def test_clashing_columns_and_rows_without_id(spark, sf):
    """Columns named like the stages' own pass through; an item in a row without id is found."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, "some words " * 30, "en", "s", 1, "x", 7), (None, f"before {item} after", "en", None, 1, "y", 8), (2, "other words " * 30, "en", "s", 1, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string, _gone long")
    for stage in (corpus_pipeline.language, corpus_pipeline.near_dedup, corpus_pipeline.repeats, corpus_pipeline.decontaminate):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept = {(r.doc_id, r._gone) for r in out.collect()}
        assert kept <= {(1, 7), (None, 8), (2, 9)}
        assert stage is not corpus_pipeline.decontaminate or kept == {(1, 7), (2, 9)}
    assert corpus_pipeline.packing(spark, docs, sf).where("doc_id IS NOT NULL").count() == 2


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
