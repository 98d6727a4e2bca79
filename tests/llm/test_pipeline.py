"""The pipeline's stages, each on the rows the one before it kept."""

from __future__ import annotations

import corpus_pipeline
from marketlens.llm.queries import TOKENIZER


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        seen[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = spark.createDataFrame(out.toPandas(), out.schema)
    ids = {n: {r["doc_id"] for r in o.select("doc_id").collect()} for n, (_, o) in seen.items()}
    assert ids["near_dedup"] <= ids["line_dedup"] <= ids["toxicity"] and ids["packing"] <= ids["near_dedup"]
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(TOKENIZER)
    before, packed = seen["packing"]
    total = sum(len(enc.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert packed.groupBy().sum("length").first()[0] == total


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
