"""The pipeline: stages are chained, keep clean documents, take effect and return the columns of documents."""

import re

import corpus_pipeline
from hiremill.llm import jaccard, packing
from tests.llm.samples import documents, rows

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "personal_data", "packing"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], SF)
        tables.append(corpus_pipeline.written(out, name))
        if name != "packing":
            assert out.schema == docs.schema
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] > ids[1] > ids[2] and ids[2] >= ids[3] and ids[3] == ids[4] == ids[5]
    clean = [i for i in ids[0] if labels.get(i) == 1]
    assert sum(i in ids[1] for i in clean) >= 0.97 * len(clean)
    parts = {r.doc_id: r.component_id for r in jaccard.components(tables[2]).collect()}
    assert ids[3] == set(parts.values())
    assert not [r.text for r in tables[4].collect() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text or "")]
    assert sorted(r.n_tokens for r in tables[5].collect()) == sorted(len(r.text.split()) for r in tables[4].collect())


def test_awkward_and_empty_tables(spark):
    for table in (documents(spark), documents(spark, [])):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == packing.pack(documents(spark, []), packing.word_length()).columns and docs.count() <= len(rows())
