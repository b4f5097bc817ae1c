"""The pipeline's stages on a small corpus, each held against what it must do to its own input."""

import corpus_pipeline
from tidebars.llm import minhash, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "kept").cache()
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, tables[-1], SF), "stage")
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= tables[-1].count()
        tables.append(out)
    kept = {r["doc_id"] for r in tables[2].collect()}
    assert kept == {r["doc_id"] for r in minhash.near_duplicates(tables[1], 80).where("kept").collect()}
    assert secrets.digest(tables[4]).where("spans <> ''").count() == 0
    assert tables[4].count() == tables[3].count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, tables[4], SF)
    assert pieces.select("doc_id").distinct().count() == tables[4].count()


def test_run_equals_the_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert set(found.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and found.count() > 0
