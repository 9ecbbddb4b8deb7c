import re

import corpus_pipeline
from capindex.llm.common import stage


def test_stages_on_the_whole_table(spark, small_dir, small_docs):
    docs, ids = small_docs.selectExpr("*"), None
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = stage(apply(spark, docs, small_dir), name)
        assert out.columns == small_docs.columns
        now = {r.doc_id for r in out.collect()}
        assert ids is None or now <= ids
        docs, ids = out, now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).collect()
    assert {p.doc_id for p in packed} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, small_dir).collect()} == ids


def test_quality_stage_keeps_clean_documents(spark, small_dir, small_docs):
    good = {r.doc_id for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, small_docs, small_dir).collect()}
    long_enough = {r.doc_id for r in small_docs.collect() if len(re.findall(r"\S+", r.text or "")) >= 30}
    assert len((good & long_enough) - kept) <= 0.02 * len(good)


def test_stages_on_an_empty_table_and_odd_rows(spark, small_dir, docs_of):
    odd = docs_of([(1, None, None, None), (None, "", None, "s"), (2, "word", "en", None), (2, "word", "en", None), (None, None)])
    for docs in (docs_of([]), odd):
        for _, apply in corpus_pipeline.STAGES:
            docs = stage(apply(spark, docs, small_dir), "odd")
        assert docs.count() >= 0
