"""The pipeline, stage by stage, over a small table."""

from __future__ import annotations

import corpus_pipeline
from lexquarry.llm import decontaminate

from .test_exact import brute_components

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = start = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, DATA).cache()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        assert ids
        if k < 4:
            assert docs.columns == start.columns
        if k == 1:
            assert ids == {c for *_, c in brute_components([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], 5, 80)}
        if k == 3:
            items = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert decontaminate.find_contamination(docs, items).where("size(hit_items) > 0").count() == 0
    assert {"weight", "probability", "topic"} <= set(docs.columns)
