import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import linking, op2_jaccard, shingles


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    ids = {}
    for i, t in rows:
        if i is not None:
            ids.setdefault(i, []).append(sets(t))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in ids[a] for y in ids[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(((i, len(sets(t)), None if i is None else find(i)) for i, t in rows), key=str)


def test_sets_match_plain_shingles():
    rng = random.Random(2)
    texts = ["", None, "a", "A b\tC", "one two three four", "One two three four FIVE", "é É x", " lead and trail \n"] + ["".join(rng.choice(["a", "b ", "É ", "\n", "Z"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    got = list(shingles.sets_of(pa.array(texts)))
    names = {}
    for text, values in zip(texts, got, strict=True):
        want = sets(text)
        assert len(values) == len(want), text
        names.setdefault(frozenset(want), set()).add(values.tobytes())
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)
    whole = list(shingles.sets_of(pa.chunked_array([pa.array(texts[:7]), pa.array(texts[7:])])))
    assert all((a == b).all() for a, b in zip(got, whole, strict=True))


def test_prefixes_and_sketches_lose_nothing():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = a.copy()
        b[rng.random(len(b)) < 0.12] += np.uint64(1)
        b = np.unique(b)[: max(1, int(len(b) * rng.uniform(0.8, 1)))]
        if linking.similar(a, b):
            last = np.sort(np.concatenate([a, b])[::3])
            assert shingles.shared(np.sort(op2_jaccard.first_order_prefix(a, last)), np.sort(op2_jaccard.first_order_prefix(b, last)))
            assert linking._orders_agree(linking.other_prefixes(a, 3), linking.other_prefixes(b, 3))
            apart = np.abs(np.frombuffer(linking.sketch(a), np.uint8).astype(int) - np.frombuffer(linking.sketch(b), np.uint8)).sum()
            assert apart * 180 <= 20 * (len(a) + len(b))


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(2, 120)))) for i in range(n)]
    base = [word() for _ in range(140)]
    for i in range(n, n + 60):  # a family whose members are not all similar to each other
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    chain = list(base[:100])
    for i in range(n + 60, n + 80):  # each similar to the one before
        chain[rng.randrange(100)] = word()
        rows.append((i, " ".join(chain)))
    passage = " ".join(word() for _ in range(60))
    rows += [(1000 + i, " ".join(word() for _ in range(50)) + " " + passage) for i in range(30)]
    rows += [(2000 + i, rows[i][1].upper() + "  ") for i in range(20)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (None, rows[0][1]), (5, rows[5][1]), (3003, "One two"), (3004, "one TWO")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small_blocks", [False, True])
def test_against_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(linking, "BLOCK", 7)
        monkeypatch.setattr(linking, "PER_SALT", 5)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op2_jaccard.similarity_classes(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long")
    assert op2_jaccard.similarity_classes(empty).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e f", 9), (1, "A b c d e f", 8), (3, None, 7), (None, "a b c d e f", 6)], "doc_id long, text string, n long")
    kept = op2_jaccard.clean_documents(docs)
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) == [6, 7, 8]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_links_are_all_similar_texts(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(linking, "BLOCK_MEMBERS", 9)
        monkeypatch.setattr(linking, "CELLS", 500)
    rows = corpus(3, 60)
    rng = random.Random(7)
    base = [f"v{k}" for k in range(300)]
    for i in range(4000, 4040):  # all similar to each other, none the same
        w = list(base)
        w[rng.randrange(300)] = f"own{i}"
        rows.append((i, " ".join(w)))
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and sets(t)):
        first.setdefault(frozenset(sets(t)), i)
    want = {i: sum(i != j and 100 * len(x & y) >= 80 * len(x | y) for y, j in first.items()) for x, i in first.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_links) for r in op2_jaccard.similarity_classes(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, 0 if i is None else want.get(first.get(frozenset(sets(t))), 0)) for i, t in rows), key=str)
    assert {n for i, n in got if i is not None and 4000 <= i < 4040} == {39}


def test_frequent_tokens_are_no_objects_on_the_driver(spark):
    from tests.llm.test_common import peak_of

    rows = spark.range(200_000).select(F.xxhash64("id").alias("token"), F.when(F.col("id") % 2 == 0, 40).otherwise(10).cast("long").alias("times"))
    got, peak = peak_of(lambda: op2_jaccard.frequent_tokens(rows.unionByName(rows), 10))
    want = np.sort(rows.where("times = 40").toArrow().column("token").to_numpy().view(np.uint64))
    assert got.dtype == np.uint64 and np.array_equal(got, want) and peak < 4 * got.nbytes + (1 << 20)
    assert len(op2_jaccard.frequent_tokens(rows.where("false"), 10)) == 0


def test_signatures_of_a_large_batch_take_little_memory(monkeypatch):
    monkeypatch.setattr(op2_jaccard, "COUNTED", 1 << 16, raising=False)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(5000)]
    common_ = " ".join(words[:40])
    texts = [" ".join(words[k] for k in rng.integers(0, 5000, 250)) + f" {common_}" for _ in range(4000)] + [None, "", "w1", "w1"]
    texts.append(" ".join(words[k] for k in rng.integers(0, 5000, 70_000)))  # more tokens than are counted at once
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    made = []
    docs = type("Docs", (), {"mapInArrow": lambda self, f, schema: made.append(f)})()
    op2_jaccard.signatures(docs)
    rows, counted, most = [], {}, 0

    def take():
        for out in made[0](iter([batch])):
            ids, sids, ns, tokens, times = (out.column(k).to_pylist() for k in (0, 1, 2, 5, 6))
            for i, sid, n, token, k in zip(ids, sids, ns, tokens, times, strict=True):
                if token is None:
                    rows.append((i, sid, n))
                else:
                    counted[token] = counted.get(token, 0) + k

    next(shingles.sets_of(batch.column(1)[:1]))  # tables that are kept
    tracemalloc.start()
    try:
        take()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == [(i, op2_jaccard.set_id(v), len(v)) for i, v in enumerate(shingles.sets_of(batch.column(1)))]
    shared = {int(v) for v in next(shingles.sets_of(pa.array([common_]))).view(np.int64)}
    assert all(counted[t] == 4000 for t in shared)
    # the sets of the whole batch alone are 9 MB
    assert most < 16 << 20, most
