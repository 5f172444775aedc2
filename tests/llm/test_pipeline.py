"""Each stage of the pipeline on its own input."""

import gc
import re
from pathlib import Path

import pyarrow as pa

import corpus_pipeline
from gistmill.llm import decontamination, jaccard, pii, queries

from .helpers import documents, empty, pairs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, by = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(by) == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    one = by["near_duplicates"](spark, docs, SF)
    linked = jaccard.link(docs).collect()
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {r["component_id"] for r in linked}
    clean = by["decontamination"](spark, docs, SF)
    leaks = {r["doc_id"] for r in decontamination.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - leaks
    plain = by["personal_data"](spark, docs, SF)
    assert plain.columns == columns and all(r["text"] == pii.redact(t["text"], pii.find(t["text"])) and r["n_chars"] == len(r["text"]) for r, t in zip(plain.orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True))
    kept = by["quality"](spark, docs, SF)
    scores = {r["doc_id"]: r["predicted"] for r in queries.op10_quality_trees(spark, SF).collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {i for i, p in scores.items() if p}
    tokens = by["tokens"](spark, docs, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded"] == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in tokens)


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() < 200


def test_stages_on_awkward_rows(spark):
    docs = documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, docs, SF), stage(spark, empty(spark), SF)
        assert none.count() == 0 and out.count() <= docs.count()
        if k < 4:
            assert out.columns == docs.columns
            assert k == 3 or set(pairs(out)) <= set(pairs(docs))


def test_workers_return_memory():
    texts = pa.array([" ".join(f"w{(i * 7 + j * j) % 5000}" for j in range(300)) for i in range(10_000)], pa.binary())

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    def run(step, batches):
        for _ in step(pa.RecordBatch.from_arrays([pa.array(range(k, k + 10_000)), pa.concat_arrays([texts])], names=["id", "text"]) for k in range(batches)):
            pass
        gc.collect()

    for step in (jaccard._set_rows, jaccard._key_rows):
        run(step, 1)  # tables that stay
        pa.default_memory_pool().release_unused()
        before = held()
        run(step, 3)
        assert held() - before < 20


def test_stages_bound_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    for own in (None, "1000000"):
        session = spark.newSession()
        if own:
            session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", own)
        docs = session.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('word ', 2000) text")
        assert corpus_pipeline.STAGES[3][1](session, docs, SF).count() == 3000
        most = docs.mapInArrow(sizes, "size long").agg({"size": "max"}).first()[0]
        assert most < 1_100_000 if own else 2_000_000 < most < 5_000_000
