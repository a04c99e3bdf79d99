"""The stages one after the other over the smallest tables, each held against what it promises."""

import corpus_pipeline
from lorekeep.llm import bpe
from lorekeep.llm.queries import BYTE_BPE
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, SF).cache()
        after = [r.asDict() for r in docs.collect()]
        rows[name] = (before, after)
        if name != "tokens":
            assert docs.columns == columns
    before, after = rows["quality_rules"]
    assert all(r in before for r in after) and all(len(r["text"].split()) >= 20 for r in after)
    before, after = rows["near_duplicates"]
    found = brute_components([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {i for i, n, c in found if n == 0 or i == c}
    before, after = rows["repeated_passages"]
    assert [r["doc_id"] for r in sorted(after, key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = rows["source_mix"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)
    before, after = rows["tokens"]
    assert sorted((r["doc_id"], bpe.encode_text(r["text"], BYTE_BPE)) for r in before) == sorted(
        (r["doc_id"], r["ids"]) for r in after)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0
