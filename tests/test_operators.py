"""Small hand-computable cases of the library's own operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import chat, graders, masked
from tallgrass.operators import advantage as A
from tallgrass.operators import balance, batch, correction, losses, metrics
from tallgrass.plans.catalogue import queries
from tallgrass.streaming import rollouts


def scored(spark, rows):
    return spark.createDataFrame([(i, u, float(s), float(n)) for i, (u, s, n) in enumerate(rows)], "row_id long, uid string, score double, length double")


def values(df, column="advantage"):
    return [r[column] for r in df.orderBy("row_id").collect()]


def test_outcome_advantages(spark):
    pair = scored(spark, [("a", 1, 1), ("a", 3, 1)])
    assert values(A.grpo(pair)) == pytest.approx([-0.7071063, 0.7071063], abs=1e-6)
    one = scored(spark, [("a", 5, 1)])
    assert values(A.rloo(one)) == [5.0] and values(A.rloo_vectorized(one)) == [0.0]
    assert values(A.grpo(one)) == pytest.approx([5 / (1 + 1e-6)])
    three = scored(spark, [("a", 0.2, 1), ("a", 1.0, 1), ("a", 0.5, 1)])
    assert values(A.grpo_passk(three, by_std=False)) == pytest.approx([0, 0.5, 0])
    assert values(A.opo(scored(spark, [("a", 1, 3), ("a", 0, 1)]))) == pytest.approx([0.25, -0.75])
    with pytest.raises(Exception, match="two rollouts"):
        A.grpo_passk(one).collect()


def test_registries():
    assert len(A.names()) == 13 and len(losses.names()) == 9 and len(correction.PRESETS) == 17 and len(correction.OPTIONS) == 11
    with pytest.raises(ValueError, match="taken"):
        A.register("grpo")(lambda df: df)
    with pytest.raises(ValueError, match="unknown"):
        A.get("GRPO")


def loop_gae(r, v, m, gamma, lam):
    nv = lg = 0.0
    out = []
    for t in reversed(range(len(r))):
        delta = r[t] + gamma * nv - v[t]
        now = delta + gamma * lam * lg
        if m[t]:
            nv, lg = v[t], now
        out.append(lg)
    return out[::-1]


def test_gae_ignores_masked_values(spark):
    r, m = [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1, 0, 0], [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rows = []
    for i, fill in enumerate((0.0, 99.0)):
        v = [fill, fill, 4, 5, 6, fill, fill, 7, 9, 0, 0]
        rows.append((i, [float(x) for x in r], [float(x) for x in v], m))
    df = spark.createDataFrame(rows, "row_id long, token_level_rewards array<double>, values array<double>, response_mask array<int>")
    got = df.select("row_id", "values", A.gae("token_level_rewards", "values", "response_mask", 0.99, 0.95).alias("a")).orderBy("row_id").collect()
    assert got[0].a == pytest.approx(got[1].a)
    assert got[0].a == pytest.approx(loop_gae(r, got[0]["values"], m, 0.99, 0.95))


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([7, 9, 2, 5, 2], [0, 0, 1, 1], [1.0, 2.0, 3.0], [1, 0, 1])], "ids array<int>, att array<int>, r array<double>, m array<int>")
    row = df.select(
        masked.response_mask_to_eos("ids").alias("eos"), masked.position_ids("att").alias("pos"), masked.fit_to(F.sequence(F.lit(1), F.lit(7)), 4, 0, True, "middle").alias("mid"),
        masked.fit_to("ids", 7, 0).alias("pad"), masked.masked_sum("r", "m").alias("s"), masked.masked_mean(F.array(F.lit(float("nan")), F.lit(2.0)), F.array(F.lit(0), F.lit(1))).alias("mean"), masked.compact("r", "m").alias("c"),
    ).first()
    assert row.eos == [1, 1, 1, 0, 0] and row.pos == [0, 0, 0, 1] and row.mid == [1, 2, 6, 7] and row.pad == [0, 0, 7, 9, 2, 5, 2]
    assert row.s == 4.0 and row["mean"] == pytest.approx(2.0) and row.c == [1.0, 3.0]
    with pytest.raises(Exception, match="longer"):
        df.select(masked.fit_to("ids", 3, 0)).collect()


def frame(spark, n=5):
    return spark.createDataFrame([(i, i * 10) for i in range(n)], "row_id long, x long")


def xs(df):
    return [r.x for r in df.orderBy("row_id").collect()]


def test_batches(spark):
    d = frame(spark)
    padded, pad = batch.pad_to_divisor(d, 5, 4)
    assert pad == 3 and xs(padded) == [0, 10, 20, 30, 40, 0, 10, 20]
    two = frame(spark, 2)
    assert xs(batch.repeat(two, 2, 2)) == [0, 0, 10, 10] and xs(batch.repeat(two, 2, 2, False)) == [0, 10, 0, 10]
    assert xs(batch.slice_rows(d, 5, None, None, -2)) == [40, 20, 0] and xs(batch.slice_rows(d, 5, 1, 4)) == [10, 20, 30]
    assert [r.chunk_id for r in batch.split(frame(spark, 10), 3).groupBy("chunk_id").count().orderBy("chunk_id").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        batch.chunk(d, 5, 2)
    with pytest.raises(Exception, match="differs"):
        batch.union_columns(d, d.withColumn("x", F.col("x") + 1)).collect()
    assert xs(batch.number(d.select("x"), F.desc("x"))) == [40, 30, 20, 10, 0]


def test_balance():
    assert balance.workload(2) == 49156
    costs = [5, 8, 1, 3, 9, 2, 7, 4]
    for equal in (False, True):
        parts = balance.karmarkar_karp(costs, 4, equal)
        assert sorted(i for p in parts for i in p) == list(range(8))
        assert not equal or all(len(p) == 2 for p in parts)
        assert max(sum(costs[i] for i in p) for p in parts) <= 12
    lengths = [100] * 4 + [200] * 4 + [150] * 4 + [50] * 4
    groups = balance.group_balanced(lengths, [i // 4 for i in range(16)], 2)
    assert sorted(i for p in groups for i in p) == list(range(16)) and all(len({i // 4 for i in p} & {i // 4 for i in q}) == 0 for p, q in [groups])
    batches = balance.micro_batches(lengths, 600, divided_by=2)
    assert len(batches) % 2 == 0 and sorted(i for b in batches for i in b) == list(range(16))


def test_metrics(spark):
    long = spark.createDataFrame([("global_seqlen/minmax_diff", 1.0), ("global_seqlen/minmax_diff", 5.0), ("x/min", 3.0), ("x/min", 2.0), ("loss", 1.0), ("loss", 2.0)], "name string, value double")
    assert {r.name: r.value for r in metrics.reduce_metrics(long).collect()} == {"global_seqlen/minmax_diff": 5.0, "x/min": 2.0, "loss": 1.5}
    votes = spark.createDataFrame([(0, "B", 0.1), (1, "A", 0.2), (2, "A", 0.3), (3, "B", 0.4)], "pos int, pred string, score double").withColumn("g", F.lit(1))
    assert metrics.majority(votes, ["g"], "pred", "score", "pos").first().score == 0.1
    rows = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate([1, 5, 2, 4])], "uid string, pos int, score double")
    got = {r.k: r for r in metrics.best_worst(rows, ["uid"], "score", "pos", 50).collect()}
    idx = metrics.bootstrap_indices(4, 2, 50)
    assert got[2].best_mean == pytest.approx(np.array([1, 5, 2, 4])[idx].max(1).mean()) and set(got) == {2, 4}
    kl = A.AdaptiveKL(0.001, 0.1, 10000)
    kl.update(0.2, 100)
    assert kl.value == pytest.approx(0.001002)


def test_corrections_keep_inside_the_mask(spark):
    rng = np.random.default_rng(0)
    rows = [(i // 10, i % 10, int(rng.random() < 0.8), float(-rng.random()), float(-rng.random())) for i in range(40)]
    tok = spark.createDataFrame(rows, "row_id int, pos int, m int, old double, roll double")
    assert correction.importance_weights(tok).agg(F.max("rho")).first()[0] <= 2.0
    for option in correction.OPTIONS:
        assert correction.reject(tok, option, "0.5_2.0" if option.endswith("k1") else 1.0).where("keep > m").isEmpty()
    for name in correction.PRESETS:
        assert "rho" in correction.apply_preset(tok, name).columns
    with pytest.raises(ValueError):
        correction.parse_thresholds(["token_k9"], "1")


def test_graders(spark):
    df = spark.createDataFrame([("… #### 1,234", "1234", "The  Beatles!", "x \\boxed{a, {b}} y", "a, b and c")], "s string, t string, q string, b string, c string")
    row = df.select(graders.gsm8k_score(F.col("s"), F.col("t")).alias("g"), graders.qa_normalize(F.col("q")).alias("q"), graders.boxed(F.col("b")).alias("b"), graders.conditions(F.col("c")).alias("c"), graders.overlong_penalty(F.lit(90), 100, 20).alias("o"), graders.boxed(F.lit("none")).alias("n"), graders.normalize_final(F.lit("x = 1,000 meters")).alias("f")).first()
    assert (row.g, row.q, row.b, set(row.c), row.o, row.n, row.f) == (1.0, "beatles", "a, {b}", {"a", "b and c"}, -0.5, None, "1000")
    assert graders.same_answer("\\frac12", "0.5") and graders.same_answer("(1, 2)", "(1,2)") and graders.same_answer("50\\%", "0.5") and not graders.same_answer("x+1", "1-x")
    assert graders.last_box("a \\boxed{1} b \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"


def test_chat(spark):
    df = spark.createDataFrame([("a<image>b<video>",)], "t string")
    row = df.select(chat.split_placeholders(F.col("t")).alias("p"), chat.flatten_parts(chat.split_placeholders(F.col("t"))).alias("f"), chat.shorten(F.lit("abcdefgh"), 4).alias("s")).first()
    assert [p["type"] for p in row.p] == ["text", "image", "text", "video"] and row.f == "a<image>b<video>" and row.s == "ab...(truncated)...gh"


def test_drop_oldest_over_a_stream(spark, tmp_path):
    spark.createDataFrame([("q", i) for i in range(1, 6)], "queue string, item long").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("queue string, item long").parquet(f"{tmp_path}/in")
    run = rollouts.drop_oldest_stream(source, 3).writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    row = spark.sql("SELECT * FROM kept").collect()[-1]
    assert sorted(row["items"])[-1] <= 5 and len(row["items"]) == 3 and row.dropped == 2
    table = spark.createDataFrame([("q", i) for i in range(1, 6)], "queue string, item long")
    assert sorted(r["item"] for r in rollouts.keep_newest(table, 3, "queue", "item").collect()) == [3, 4, 5]


def test_catalogue_names(spark):
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_k3_and_thresholds():
    assert math.isclose(correction.parse_thresholds(["token_k1"], "2")["token_k1"][0], 0.5)


def test_best_worst_query_covers_every_order(spark, tmp_path):
    rng = np.random.default_rng(4)
    sizes = {1: 4, 399: 1, 400: 2, 401: 3, 90_000: 7, 90_001: 7, 5_000_000_000: 5}
    rows = [(key, n, float(rng.integers(100, 9000)) / 4) for key, size in sizes.items() for n in range(1, size + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for key, size in sizes.items():
        x = np.array([v for k, _, v in rows if k == key])
        for k in sorted({2, 4, size} if size > 4 else {2, size}) if size > 1 else []:
            y = x[np.random.RandomState(42).choice(size, size=(200, k), replace=True)]
            want[key, k] = (y.max(1).mean(), y.max(1).std(), y.min(1).mean(), y.min(1).std())
    got = {(r.l_orderkey, r.k): (r.best_mean, r.best_std, r.worst_mean, r.worst_std) for r in queries()["best_worst_bootstrap"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], rtol=1e-12) for c in want)
