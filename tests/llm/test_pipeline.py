"""The corpus pipeline against its stages' meaning, on the smallest tables."""

import hashlib

import corpus_pipeline
from pointweave.llm import decontam, quality
from tests.llm.test_operators import base_spans, empty, groups, messy  # noqa: F401


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        kept[name] = (before, docs)
        if name != names[-1]:
            assert docs.columns == columns
    before, after = kept["quality"]
    merit = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert after.count() == quality.score(before, merit, ["doc_id"]).where("score >= 0.3").count()
    before, after = kept["near_duplicates"]
    rows = [(r["doc_id"], r["text"] or "") for r in before.collect()]
    expected = {d for d, (_, c) in groups(rows, 5, 80).items() if d == c}
    assert {r["doc_id"] for r in after.collect()} == expected
    before, after = kept["decontamination"]
    dirty = decontam.report(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count()
    assert after.count() == before.count() - dirty
    before, after = kept["personal_data"]
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not base_spans(text[r["doc_id"]]):
            assert len(r["text"]) == len(text[r["doc_id"]]) or "[IBAN]" in r["text"]
    for r in kept["encoding"][1].collect():
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_stages_take_odd_tables(spark, sf, messy, empty):  # noqa: F811
    odd = messy.selectExpr("*", "1 AS decoded", "2 AS n_tokens", "3 AS pii_text", "4 AS component")
    for docs in (odd, odd.limit(0), empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert len(set(out.columns)) == len(out.columns)
            if name != "encoding":
                assert out.columns == docs.columns
            n = out.count()
            assert n == docs.count() if name in ("personal_data", "encoding") else n <= docs.count()
