import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import common


def test_fresh_names():
    assert common.fresh("_d", ["a"]) == "_d" and common.fresh("_d", ["_D", "x"], ["_d_"]) == "_d__"


def test_slices_keep_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"i": list(range(100)), "t": ["x" * (5000 if k == 50 else 10) for k in range(100)]})
    parts = list(common.slices(batch, 1000))
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(100)) and max(p.nbytes for p in parts if p.num_rows > 1) <= 1000


def test_one_state_at_a_time():
    made = []
    build = lambda x: made.append(x) or x
    assert [common.held("a", lambda: build(1)), common.held("a", lambda: build(2)), common.held("b", lambda: build(3)), common.held("a", lambda: build(4))] == [1, 1, 3, 4]
    assert made == [1, 3, 4] and len(common._STATE) == 1


def test_state_of_another_function_goes_before_the_next_one_runs():
    seen = []

    def one(batches):
        common.held("one", lambda: seen.append("built"))
        yield from batches

    def two(batches):
        seen.append(len(common._STATE))
        yield from batches

    first, second = common.by_slices(one), common.by_slices(two)
    for run in (first, first, second):
        list(run(iter([])))
    assert seen == ["built", 0]


def test_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    try:
        common.small_batches(spark)
        found = [r.n for r in spark.range(9000).selectExpr("repeat('x', 2000) AS t").coalesce(1).mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(found) > 9000 * 2000 and max(found) < common.BATCH + 100_000


def test_lines_and_rows_go_whatever_columns_are_called(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc", 1, 2, 3, 4), (2, None, 5, 6, 7, 8), (3, "x", 0, 0, 0, 0), (None, "a\nb", 0, 0, 0, 0)], "doc_id long, text string, _doc int, _places int, _gone int, _key_doc_id int")
    gone = spark.createDataFrame([(1, 1), (1, 3), (1, 1), (3, 0)], "doc_id long, place int")
    out = common.without_lines(docs, gone, "n")
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs.columns, "n"]
    assert (rows[1].text, rows[1].n, rows[1]._gone) == ("a\n", 2, 3) and (rows[2].text, rows[2].n) == (None, 0) and (rows[3].text, rows[3].n) == ("", 1) and rows[None].n == 0
    left = common.without_rows(docs, spark.createDataFrame([(1,)], "doc_id long"), {"doc_id": F.col("doc_id").cast("long")})
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, None}


def test_shared_folder_is_needed_on_a_cluster():
    from tallgrass.sources.durable import shared_dir

    unset = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(isLocal=lambda: False, getConf=lambda: unset))
    with pytest.raises(RuntimeError):
        shared_dir(session)


def peak_of(run):
    """What run() returns, and the most bytes that Python objects and arrays took meanwhile."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_filter_has_every_key_and_no_object_for_each_word(spark):
    keys = spark.range(300_000).select(F.xxhash64("id").alias("k"))
    words, peak = peak_of(lambda: common.key_bits(keys.unionByName(spark.createDataFrame([(None,), (-1,)], "k long")), True))
    hashes = np.append(keys.toArrow().column("k").to_numpy(), -1)
    want = np.unique(hashes.view(np.uint64) & np.uint64(64 * len(words) - 1))
    assert common.has_bits(words, hashes).all() and sum(int(w).bit_count() for w in words) == len(want)
    assert peak < 4 * words.nbytes + (1 << 22)
    assert not common.key_bits(spark.createDataFrame([], "k long")).any()


def test_large_filter_comes_to_the_driver_in_parts(spark, monkeypatch):
    keys = spark.range(300_000).select(F.xxhash64("id").alias("k"))
    whole = common.key_bits(keys, True)
    monkeypatch.setattr(common, "FILTER_PART", 1 << 20)
    seen, columns_of = [], common.columns_of
    monkeypatch.setattr(common, "columns_of", lambda df: (seen.append(len(c[0])) or c for c in columns_of(df)))
    words, peak = peak_of(lambda: common.key_bits(keys, True))
    assert (words == whole).all() and sum(seen) == np.count_nonzero(whole) and max(seen) <= 1 << 14
    assert peak < 2.5 * words.nbytes
    # nor is there a copy for the broadcast
    kept = common.may_have(spark, keys)(F.col("id"))
    assert spark.range(5).select(F.xxhash64("id").alias("id")).where(kept).count() == 5
    large = np.zeros(1 << 22, dtype=np.uint64)
    monkeypatch.setattr(common, "key_bits", lambda keys, hashed=False: large)
    assert peak_of(lambda: common.may_have(spark, keys))[1] < 1 << 22
