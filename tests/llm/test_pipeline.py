"""The pipeline's stages on small tables, against plain versions where one exists."""

import corpus_pipeline
from tesserine.llm import quality_model, secret_forest

from .test_jaccard import plain


def test_stages_follow_each_other(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, tiny).cache()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_model.rated(docs, labels).where("kept").collect()}
    groups = plain([(r.doc_id, r.text) for r in kept.collect()])
    single = stages["near_duplicates"](spark, kept, tiny).cache()
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c}
    clean = stages["secrets"](spark, single, tiny).cache()
    want = {}
    for r in single.collect():
        t = r.text
        for a, b, _ in reversed(secret_forest.scan(t, r.source)[1]):
            t = t[:a] + secret_forest.MASK + t[b:]
        want[r.doc_id] = (t, len(t))
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == want
    mixed = stages["mixing"](spark, clean, tiny).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(want)
    packed = stages["packing"](spark, mixed, tiny)
    assert {r.doc_id for r in packed.collect()} == set(want)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_on_an_empty_table(spark, tiny, tmp_path):
    spark.read.parquet(f"{tiny}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tiny}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
