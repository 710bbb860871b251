import gc

import pytest

import corpus_pipeline
from tests.llm import test_decontam, test_jaccard, test_lines

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{name}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            ids = {r.doc_id for r in kept[name]}
            clean = [i for i, t in labels.items() if not t]
            assert sum(i in ids for i in clean) > 0.95 * len(clean)
        elif name == "line_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            gone = test_lines.repeated_runs([(i, t or "") for i, t in rows], 30)
            assert gone
            want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
            assert {r.doc_id: r.text for r in kept[name]} == want
            assert all(r.n_chars == len(r.text) for r in kept[name] if r.text not in {t for _, t in rows})
        elif name == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {i for i, n, label in test_jaccard.brute(rows) if label == i}
            assert {r.doc_id for r in kept[name]} == want
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            want = {r[0] for r in test_decontam.brute([(r.doc_id, r.text) for r in before.collect()], items) if not r[5]}
            assert {r.doc_id for r in kept[name]} == want
        else:
            assert {r.doc_id for r in kept[name]} == {r.doc_id for r in kept["decontaminate"]} and all(r.token_ids for r in kept[name] if r.text.strip())


def test_heap_of_the_stage_before_is_given_back(spark):
    docs, jvm = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.sparkContext._jvm
    for name, stage in corpus_pipeline.STAGES[1::3]:  # line_dedup and bpe
        runtime = jvm.java.lang.Runtime.getRuntime()
        large = jvm.java.nio.ByteBuffer.allocate(1 << 30)
        assert runtime.totalMemory() > 1 << 30
        del large
        gc.collect()
        stage(spark, docs, SMALL)
        assert runtime.totalMemory() < 1 << 30, name


def test_every_stage_settles_before_anything_else(spark, monkeypatch):
    class Settled(Exception):
        pass

    def settle(_):
        raise Settled

    monkeypatch.setattr(corpus_pipeline, "settle", settle)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Settled):
            stage(spark, None, SMALL)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
