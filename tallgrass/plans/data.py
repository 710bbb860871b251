"""Catalogue: batches, metrics, graders, preparation, retrieval, streams, and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import chat, graders, masked
from tallgrass.operators import balance, batch, metrics, prep, retrieval
from tallgrass.plans.catalogue import query
from tallgrass.plans.views import TOK, r6, tokens
from tallgrass.streaming import rollouts as stream


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# batches ---------------------------------------------------------------------------------------------------------------------------------
_CUST = "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, c_nationkey FROM customer"

_N = "(SELECT count(*) AS n FROM customer)"


def _cust(spark, sf):
    """customer with dense row ids, and how many."""
    df = batch.number(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return df, df.count()


def _batch(name, sql, fn):
    query(name, sql)(lambda spark, sf: fn(*_cust(spark, sf)))


_batch("batch_repeat", f"SELECT row_id * 3 + k AS row_id, c_custkey FROM ({_CUST}), range(3) t(k)", lambda d, n: batch.repeat(d, n, 3).select("row_id", "c_custkey"))
_batch("batch_tile", f"SELECT k * (SELECT count(*) FROM customer) + row_id AS row_id, c_custkey FROM ({_CUST}), range(3) t(k)", lambda d, n: batch.repeat(d, n, 3, False).select("row_id", "c_custkey"))
_batch("batch_repeat_each", f"SELECT row_number() OVER (ORDER BY row_id, k) - 1 AS row_id, c_custkey FROM (SELECT row_id, c_custkey, unnest(range(c_nationkey % 3)) AS k FROM ({_CUST}))", lambda d, n: batch.repeat_each(d, F.col("c_nationkey") % 3).select(F.col("row_id").cast("long"), "c_custkey"))
_batch("batch_chunk", f"SELECT row_id, c_custkey, floor(row_id / ceil((SELECT count(*) FROM customer) / 7))::BIGINT AS chunk_id FROM ({_CUST})", lambda d, n: batch.chunk(d, n, 7, True).select("row_id", "c_custkey", "chunk_id"))
_batch("batch_split", f"SELECT row_id, c_custkey, row_id // 64 AS chunk_id FROM ({_CUST})", lambda d, n: batch.split(d, 64).select("row_id", "c_custkey", "chunk_id"))
_batch("batch_pad_cyclic", f"WITH c AS ({_CUST}), n AS (SELECT count(*) AS n FROM customer) SELECT i AS row_id, c_custkey FROM n, range(n + (64 - n % 64) % 64) t(i) JOIN c ON c.row_id = i % n", lambda d, n: batch.pad_to_divisor(d, n, 64)[0].select("row_id", "c_custkey"))
_batch("batch_pad_last", f"WITH c AS ({_CUST}), n AS (SELECT count(*) AS n FROM customer) SELECT i AS row_id, c_custkey FROM n, range(n + 5) t(i) JOIN c ON c.row_id = least(i, n - 1)", lambda d, n: batch.pad_rows(d, n, 5).select("row_id", "c_custkey"))
_batch("batch_unpad", f"SELECT row_id, c_custkey FROM ({_CUST}) WHERE row_id < (SELECT count(*) - 5 FROM customer)", lambda d, n: batch.unpad(d, n, 5).select("row_id", "c_custkey"))
_batch("batch_slice", f"WITH c AS ({_CUST}), n AS (SELECT count(*) AS n FROM customer) SELECT (n - 3 - row_id) // 4 AS row_id, c_custkey FROM c, n WHERE row_id > 10 AND row_id <= n - 3 AND (n - 3 - row_id) % 4 = 0", lambda d, n: batch.slice_rows(d, n, -3, 10, -4).select("row_id", "c_custkey"))
_batch(
    "batch_gather",
    f"WITH c AS ({_CUST}), n AS (SELECT count(*) AS n FROM customer) SELECT i AS row_id, c_custkey FROM n, range(n) t(i) JOIN c ON c.row_id = (i * 7 + i // 3) % n",
    lambda d, n: batch.select_rows(d, d.sparkSession.range(n).select(F.col("id").alias("pos"), ((F.col("id") * 7 + F.floor(F.col("id") / 3)) % n).alias("idx"))).select("row_id", "c_custkey"),
)
#: All rows, filled up to whole groups of 50 from the head, as a batch has to be.
_FULL = f"(SELECT i, c_custkey FROM {_N}, range(n + (50 - n % 50) % 50) t(i) JOIN ({_CUST}) c ON c.row_id = i % n)"


def _full(d, n):
    return batch.pad_to_divisor(d, n, 50)[0], n + -n % 50


_batch("batch_mask", f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, c_custkey FROM ({_CUST}) WHERE c_nationkey = 3", lambda d, n: batch.where_mask(d, F.col("c_nationkey") == 3).select(F.col("row_id").cast("long"), "c_custkey"))
_batch("batch_union", f"SELECT row_id, c_custkey, c_nationkey, c_custkey * 2 AS twice FROM ({_CUST})", lambda d, n: batch.union_columns(d, d.select("row_id", "c_custkey", (F.col("c_custkey") * 2).alias("twice"))))
_batch("batch_concat", f"SELECT row_id, c_custkey FROM ({_CUST}) UNION ALL SELECT row_id + (SELECT count(*) FROM customer), c_custkey FROM ({_CUST})", lambda d, n: batch.concat([d.select("row_id", "c_custkey")] * 2, [n, n]))
_batch(
    "batch_fold",
    f"SELECT i // 50 AS row_id, array_to_string(list(c_custkey ORDER BY i), ',') AS keys FROM {_FULL} GROUP BY 1",
    lambda d, n: (lambda p, m: batch.fold(p, m, m // 50, ["c_custkey"]).select("row_id", F.array_join("c_custkey", ",").alias("keys")))(*_full(d, n)),
)
_batch("batch_unfold", f"SELECT i AS row_id, c_custkey FROM {_FULL}", lambda d, n: (lambda p, m: batch.unfold(batch.fold(p, m, m // 50, ["c_custkey"]), ["c_custkey"], 50))(*_full(d, n)))
_batch("batch_unfold_cols", f"SELECT row_id * 2 + k AS row_id, c_custkey, array_to_string([c_custkey * 4 + k * 2, c_custkey * 4 + k * 2 + 1], ',') AS part FROM ({_CUST}), range(2) t(k)", lambda d, n: batch.unfold_column_chunks(d.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("c_custkey") * 4 + i)), 2, ["x"]).select("row_id", "c_custkey", F.array_join("x", ",").alias("part")))
_batch(
    "batch_iterate",
    f"SELECT e::INTEGER AS epoch, i // 10 AS batch_id, c_custkey FROM {_FULL}, range(2) t(e)",
    lambda d, n: (lambda p, m: batch.mini_batches(p, m, 10, 2).select("epoch", "batch_id", "c_custkey"))(*_full(d, n)),
)
_batch(
    "batch_replicate",
    f"SELECT r::INTEGER AS rank, c_custkey FROM (SELECT *, floor(row_id / ceil((SELECT count(*) FROM customer) / 2))::BIGINT AS chunk_id FROM ({_CUST})), range(4) t(r) WHERE chunk_id = r // 2",
    lambda d, n: batch.replicate(batch.chunk(d, n, 2, True), [0, 0, 1, 1]).select("rank", "c_custkey"),
)

# metrics ---------------------------------------------------------------------------------------------------------------------------------
_LONG = "SELECT event_id % 37 AS step, event_id % 4 AS rank, CASE event_id % 5 WHEN 0 THEN 'seq/minmax_diff' WHEN 1 THEN 'loss/min' WHEN 2 THEN 'score/mean' WHEN 3 THEN 'timing_s/gen' ELSE 'sample_count' END AS name, CASE event_id % 4 WHEN 0 THEN 'sum' WHEN 1 THEN 'mean' WHEN 2 THEN 'max' ELSE 'min' END AS agg, event_id, value FROM events"


def _long(spark, sf):
    return spark.sql(_LONG.replace("FROM events", "FROM {ev}"), ev=_t(spark, sf, "events"))


query("reduce_metrics", f"SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM ({_LONG}) GROUP BY name")(lambda spark, sf: metrics.reduce_metrics(_long(spark, sf)).select("name", r6("value").alias("value")))
query("metric_dp_merge", f"SELECT name, agg, round(CASE agg WHEN 'sum' THEN sum(m) WHEN 'max' THEN max(hi) WHEN 'min' THEN min(lo) ELSE avg(m) END, 6) + 0.0 AS value FROM (SELECT name, agg, step, avg(value) AS m, max(value) AS hi, min(value) AS lo FROM ({_LONG}) GROUP BY ALL) GROUP BY name, agg")(lambda spark, sf: metrics.merge_ranks(_long(spark, sf)).select("name", "agg", r6("value").alias("value")))
query(
    "async_metric_rules",
    f"SELECT name, CASE WHEN contains(name, 'timing_s/') THEN 'time_sum' WHEN contains(name, 'mean') THEN 'avg' WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' ELSE 'sum' END AS rule, round(CASE WHEN contains(name, 'timing_s/') OR contains(name, 'count') THEN sum(value) WHEN contains(name, 'mean') THEN avg(value) WHEN contains(name, 'max') THEN max(value) ELSE min(value) END, 6) + 0.0 AS value FROM ({_LONG}) GROUP BY name",
)(lambda spark, sf: metrics.aggregate_async(_long(spark, sf)).select("name", "rule", r6("value").alias("value")))
query("latency_percentiles", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean, max(value) AS hi, min(value) AS lo, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, round(quantile_cont(value, 0.99), 6) + 0.0 AS p99, count(DISTINCT user_id) AS versions FROM events GROUP BY event_type")(
    lambda spark, sf: _t(spark, sf, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), F.max("value").alias("hi"), F.min("value").alias("lo"), *[r6(F.percentile("value", q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)], F.count_distinct("user_id").alias("versions"))
)
_ROWS = "SELECT round(o_totalprice / 1000, 2) AS score, round(o_totalprice / 1500, 2) AS reward, o_custkey % 700 AS prompt_length, o_orderkey % 50 AS response_length FROM orders"
query(
    "data_metrics",
    "SELECT " + ", ".join(f"round({f}({c}) FILTER (response_length > 0), 6) + 0.0 AS {c}_{n}" for c in ("score", "reward") for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))) + ", " + ", ".join(f"round({f}({c}), 6)::DOUBLE + 0.0::DOUBLE AS {c}_{n}" for c in ("prompt_length", "response_length") for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))) + f", round(avg((response_length = 49)::INT), 6) + 0.0 AS clip_ratio, round(avg((response_length = 0)::INT), 6) + 0.0 AS aborted_ratio FROM ({_ROWS})",
)(lambda spark, sf: (lambda d: d.select(*[r6(F.col(c).cast("double")).alias(c) for c in d.columns]))(metrics.sequence_metrics(spark.sql(_ROWS.replace("FROM orders", "FROM {o}"), o=_t(spark, sf, "orders")), 49)))
query("explained_variance", f"SELECT round(1 - var_samp(ret - v) FILTER (m <> 0) / (var_samp(ret) FILTER (m <> 0) + 1e-5), 6) + 0.0 AS explained_variance FROM ({TOK})")(lambda spark, sf: tokens(spark, sf).agg(r6(metrics.explained_variance(tokens(spark, sf))).alias("explained_variance")))
query(
    "maj_vote",
    "WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS p, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT user_id, event_type, value FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, p) = 1",
)(lambda spark, sf: metrics.majority(_t(spark, sf, "events"), ["user_id"], "event_type", "value", "event_id"))
query(
    "validation_mean_std",
    "WITH p AS (SELECT c_mktsegment AS data_source, o_custkey AS uid, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT data_source, round(avg(m), 4) + 0.0 AS mean, round(avg(s), 4) + 0.0 AS std, max(n) AS n_max FROM p GROUP BY 1",
)(lambda spark, sf: metrics.validation_means(_t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("data_source"), F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("score"))).select("data_source", r6("mean", 4).alias("mean"), r6("std", 4).alias("std"), "n_max"))
query("best_worst_bootstrap")(lambda spark, sf: metrics.best_worst(_t(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber", 200))
query("traj_ordinal", "WITH a AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a) SELECT event_id, (row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1)::INTEGER AS traj_ordinal FROM b")(
    lambda spark, sf: metrics.islands(_t(spark, sf, "events"), "event_type", "user_id", "event_id").select("event_id", "traj_ordinal")
)
query("workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS cost FROM documents")(lambda spark, sf: _t(spark, sf, "documents").select("doc_id", balance.workload(F.col("n_chars")).alias("cost")))
query("karmarkar_karp")(lambda spark, sf: balance.plan(_t(spark, sf, "documents"), "source", "n_chars", "doc_id", k=4))
query("microbatch_plan")(lambda spark, sf: balance.plan(_t(spark, sf, "documents"), "source", "n_chars", "doc_id", max_tokens=200_000))

# graders ---------------------------------------------------------------------------------------------------------------------------------
_SOL = "SELECT doc_id, 'so ' || n_chars || ' and #### ' || (doc_id % 7) || ',' || (doc_id % 100) || ' ok' AS sol, (doc_id % 5) || '' || (doc_id % 100) AS truth FROM documents"


def _sol(spark, sf, sql=_SOL):
    _t(spark, sf, "documents").select("doc_id", "n_chars", "source").createOrReplaceTempView("solved_documents")
    return spark.sql(sql.replace("FROM documents", "FROM solved_documents"))


query("grade_gsm8k_strict", f"SELECT doc_id, replace(regexp_extract(sol, '#### (-?[0-9.,]+)', 1), ',', '') AS answer, (replace(regexp_extract(sol, '#### (-?[0-9.,]+)', 1), ',', '') = truth)::INT::DOUBLE AS score FROM ({_SOL})")(lambda spark, sf: _sol(spark, sf).select("doc_id", graders.gsm8k_answer(F.col("sol")).alias("answer"), graders.gsm8k_score(F.col("sol"), F.col("truth")).alias("score")))
query("grade_gsm8k_flexible", f"SELECT doc_id, list_filter(regexp_extract_all(sol, '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.'))[-1] AS answer FROM ({_SOL})")(lambda spark, sf: _sol(spark, sf).select("doc_id", graders.gsm8k_answer(F.col("sol"), "flexible").alias("answer")))
_TAG = "SELECT doc_id, '<think>x</think> <answer>The  ' || source || '!</answer>' AS sol, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'src' END AS truth FROM documents"
query("grade_qa_em", f"SELECT doc_id, (sol LIKE '%  ' || truth || '!%')::INT::DOUBLE AS score FROM ({_TAG})")(lambda spark, sf: _sol(spark, sf, _TAG).select("doc_id", graders.qa_score(F.col("sol"), F.array("truth")).alias("score")))
query("grade_qa_subem", f"SELECT doc_id, contains(lower(sol), lower(truth))::INT::DOUBLE AS score FROM ({_TAG.replace("'src' END", "'srx' END")})")(
    lambda spark, sf: _sol(spark, sf, _TAG.replace("'src' END", "'srx' END")).select("doc_id", graders.qa_score(F.col("sol"), F.array("truth"), True).alias("score"))
)
_BOX = "SELECT doc_id, '<think>x</think> \\boxed{' || CASE doc_id % 3 WHEN 0 THEN 'a, b' WHEN 1 THEN 'a' ELSE 'c, d and {e}' END || '} end' AS sol, 'A,B' AS truth FROM documents"
query("grade_tactile", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 ELSE 0.1 END::DOUBLE AS score, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.666667 ELSE 0 END::DOUBLE AS f1 FROM ({_BOX})")(lambda spark, sf: _sol(spark, sf, _BOX.replace("\\", "\\\\")).withColumn("g", graders.tactile(F.col("sol"), F.col("truth"))).select("doc_id", r6("g.score").alias("score"), r6("g.f1").alias("f1")))
query("grade_medical", f"SELECT doc_id, round(CASE doc_id % 3 WHEN 0 THEN 0.5 * 1.0 + 0.3 * 0 + 0.2 WHEN 1 THEN 0.5 * 2 / 3::DOUBLE + 0.2 ELSE 0.2 END, 6)::DOUBLE AS score FROM ({_BOX})")(lambda spark, sf: _sol(spark, sf, _BOX.replace("\\", "\\\\")).withColumn("g", graders.medical(F.col("sol"), F.col("truth"))).select("doc_id", r6("g.score").alias("score")))
query("grade_human_behaviour")(lambda spark, sf: _sol(spark, sf, _BOX.replace("\\", "\\\\")).withColumn("g", graders.human_behaviour(F.col("sol"), F.col("truth"))).select("doc_id", r6("g.score").alias("score")))
query("grade_math")(lambda spark, sf: _sol(spark, sf, _BOX.replace("\\", "\\\\")).select("doc_id", graders.math_score("sol", "truth").alias("score")))
_ANS = "SELECT doc_id, 'work. Answer: x = ' || (doc_id % 4) || ',000 units' AS sol, '2000' AS truth FROM documents"
query("grade_dapo", f"SELECT doc_id, (doc_id % 4) || CASE WHEN true THEN '000' END AS pred, CASE WHEN doc_id % 4 = 2 THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM ({_ANS})")(lambda spark, sf: _sol(spark, sf, _ANS).withColumn("g", graders.dapo_math(F.col("sol"), F.col("truth"))).select("doc_id", "g.pred", "g.score"))
query("overlong_penalty", "SELECT doc_id, round(least(-(n_chars - 800) / 200::DOUBLE, 0), 6) + 0.0 AS penalty FROM documents")(lambda spark, sf: _t(spark, sf, "documents").select("doc_id", r6(graders.overlong_penalty(F.col("n_chars"), 1000, 200)).alias("penalty")))
query("toolcall_bonus", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 0.1 ELSE 0 END::DOUBLE AS score FROM conversations")(lambda spark, sf: _t(spark, sf, "conversations").select("conv_id", "turn", graders.toolcall_bonus(F.lit(0.0), F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("<tool_call>"))).otherwise(F.col("text"))).alias("score")))
query("eval_by_source", f"SELECT source, round(avg(s), 6) + 0.0 AS score FROM (SELECT source, doc_id, avg((replace(regexp_extract(r, '#### (-?[0-9.,]+)', 1), ',', '') = (doc_id % 3)::VARCHAR)::INT) AS s FROM (SELECT doc_id, source, unnest(['#### ' || (doc_id % 2), '#### ' || (doc_id % 3), 'none']) AS r FROM documents) GROUP BY 1, 2) GROUP BY 1")(
    lambda spark, sf: _t(spark, sf, "documents").select("doc_id", "source", F.explode(F.array(F.concat(F.lit("#### "), (F.col("doc_id") % 2).cast("string")), F.concat(F.lit("#### "), (F.col("doc_id") % 3).cast("string")), F.lit("none"))).alias("r"))
    .groupBy("source", "doc_id").agg(F.avg(graders.gsm8k_score(F.col("r"), (F.col("doc_id") % 3).cast("string"))).alias("s")).groupBy("source").agg(r6(F.avg("s")).alias("score"))
)

# preparation and chat --------------------------------------------------------------------------------------------------------------------
query("prep_rl", "SELECT doc_id, source AS data_source, 'user' AS role, text AS content, doc_id::VARCHAR AS ground_truth, 'train' AS split FROM documents")(lambda spark, sf: _t(spark, sf, "documents").select("doc_id", *prep.rl_row(F.col("source"), F.col("text"), F.col("doc_id").cast("string"), "math", "train", F.col("doc_id"))).select("doc_id", "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.split"))
query("prep_rm_explode", "SELECT doc_id, unnest([lang, source]) AS response FROM documents")(lambda spark, sf: prep.preference_to_sft(_t(spark, sf, "documents").select("doc_id", F.col("lang").alias("chosen"), F.col("source").alias("rejected"))))
query("stratified_sample", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn <= greatest(1, floor(n * 0.1))")(lambda spark, sf: prep.stratified(_t(spark, sf, "documents"), "source", 10, F.struct(F.col("doc_id") * 7919 % 1009, "doc_id")).select("doc_id", "source"))
query("interleave", "WITH a AS (SELECT doc_id AS id, 0 AS side, (row_number() OVER (ORDER BY doc_id) - 1) / count(*) OVER ()::DOUBLE AS spot FROM documents), b AS (SELECT page_id AS id, 1 AS side, (row_number() OVER (ORDER BY page_id) - 1) / count(*) OVER ()::DOUBLE AS spot FROM pages) SELECT id, side, row_number() OVER (ORDER BY spot, side, id) AS place FROM (FROM a UNION ALL FROM b)")(
    lambda spark, sf: (lambda a, b: batch.number(prep.interleave(a, a.count(), b, b.count()), "place").select("id", "place.side", (F.col("row_id") + 1).cast("long").alias("place")))(batch.number(_t(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id"), batch.number(_t(spark, sf, "pages").select(F.col("page_id").alias("id")), "id"))
)
query("filter_groups", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)")(lambda spark, sf: prep.filter_constant_groups(_t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
query("filter_len", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) <= 200")(lambda spark, sf: _t(spark, sf, "documents").where(chat.token_count(F.col("text")) <= 200).select("doc_id"))
query("key_split", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'train' ELSE 'test' END AS split FROM documents d LEFT JOIN labels l USING (doc_id)")(lambda spark, sf: prep.split_by_keys(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), ["doc_id"]))
query("extra_info", "SELECT event_id, (props->>'k') AS k, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE 'none' END AS missing FROM events")(
    lambda spark, sf: _t(spark, sf, "events").withColumn("p", F.when(F.col("event_id") % 2 == 0, F.concat(F.rtrim("props", F.lit("}")), F.lit(', "missing": "e'), "event_id", F.lit('"}'))).otherwise(F.col("props"))).select("event_id", *prep.extra_info(F.col("p"), {"k": "", "missing": "none"}))
)
_PLACED = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<image>' || text || '<video>' WHEN 1 THEN text || '<image><image>' ELSE text END AS content, text FROM conversations"
query("split_placeholders", f"SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 3 = 0 THEN 'image' END, CASE WHEN text <> '' THEN 'text' END, CASE turn % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'image,image' END) AS kinds FROM ({_PLACED})")(
    lambda spark, sf: spark.sql(_PLACED.replace("FROM conversations", "FROM {c}"), c=_t(spark, sf, "conversations")).select("conv_id", "turn", F.array_join(F.transform(chat.split_placeholders(F.col("content")), lambda p: p["type"]), ",").alias("kinds"))
)
query("parse_tool_calls", "SELECT conv_id, turn, 'f' || turn AS name, conv_id::VARCHAR AS x, text AS content FROM conversations")(
    lambda spark, sf: _t(spark, sf, "conversations").withColumn("s", F.concat("text", F.lit('<tool_call>{"name": "f'), "turn", F.lit('", "arguments": {"x": "'), "conv_id", F.lit('"}}</tool_call><tool_call>no json</tool_call>'))).withColumn("c", chat.tool_calls(F.col("s"))).select("conv_id", "turn", F.col("c")[0]["name"].alias("name"), F.col("c")[0]["arguments"]["x"].alias("x"), chat.without_calls(F.col("s")).alias("content"))
)


def _convs(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))


query("last_assistant", "SELECT conv_id, max(text) FILTER (turn = t) AS content FROM (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS t FROM conversations) GROUP BY 1")(lambda spark, sf: _convs(spark, sf).select("conv_id", chat.last_of(F.col("messages"), "assistant").alias("content")))
query("conv_loss_mask", "SELECT conv_id, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS trained FROM (SELECT conv_id, role, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS n FROM conversations) GROUP BY 1")(
    lambda spark, sf: _convs(spark, sf).withColumn("mask", F.flatten(F.transform("messages", lambda m: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), chat.token_count(m["content"]))))).select("conv_id", F.size("mask").cast("long").alias("tokens"), masked.mask_sum("mask").cast("long").alias("trained"))
)
query("conv_truncate")(lambda spark, sf: _convs(spark, sf).select("conv_id", F.size(F.coalesce(chat.truncated(F.col("messages"), 300), F.array().cast("array<struct<turn:bigint,role:string,content:string>>"))).alias("n")))
query("fit_middle", f"SELECT row_id, sum(CASE WHEN n <= 20 THEN x WHEN pos < 10 OR pos >= n - 10 THEN x ELSE 0 END)::BIGINT AS total, 20::BIGINT AS width FROM (SELECT row_id, pos, event_id AS x, count(*) OVER (PARTITION BY row_id) AS n FROM ({TOK})) GROUP BY 1")(
    lambda spark, sf: tokens(spark, sf).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id"))).alias("x")).select("row_id", masked.fit_to(F.col("x.event_id"), 20, 0, True, "middle").alias("y")).select("row_id", masked.total(F.transform("y", lambda v: v.cast("double"))).cast("long").alias("total"), F.size("y").cast("long").alias("width"))
)

# retrieval -------------------------------------------------------------------------------------------------------------------------------
query(
    "topk_similarity",
    "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) SELECT query_id, id, round(list_dot_product(q.e, c.e), 6) + 0.0 AS score FROM q, c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q.e, c.e) DESC, id) <= 10",
)(lambda spark, sf: (lambda e: retrieval.top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), 10).select("query_id", "id", r6("score").alias("score")))(_t(spark, sf, "embeddings")))
query("bm25_topk")(lambda spark, sf: retrieval.bm25(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("contents")), _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5).select("query_id", "id", r6("score").alias("score"), "rank"))

# streams, as tables ----------------------------------------------------------------------------------------------------------------------
query("queue_drop_oldest", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")(lambda spark, sf: stream.keep_newest(_t(spark, sf, "events"), 20, "user_id", "ts", "event_id").select("event_id", "user_id"))
query("queue_statistics", "SELECT user_id, count(*) AS produced, least(count(*), 60)::BIGINT AS size, greatest(count(*) - 60, 0)::BIGINT AS dropped FROM events GROUP BY 1")(lambda spark, sf: stream.queue_statistics(_t(spark, sf, "events"), 60, "user_id"))
query("count_window", "SELECT event_id, rn // 16 AS batch_no FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn < n // 16 * 16")(lambda spark, sf: stream.count_windows(_t(spark, sf, "events"), 16, "user_id", "ts", "event_id").select("event_id", "batch_no"))
query("staleness_filter", "WITH p AS (SELECT event_id // 500 AS cur, count(*) FILTER (event_id // 500 - event_id // 500 + (event_id % 3) >= 1) AS stale FROM events GROUP BY 1) SELECT cur, stale, (sum(stale) OVER (ORDER BY cur))::BIGINT AS stale_total FROM p")(lambda spark, sf: stream.stale_counts(_t(spark, sf, "events").select(F.floor(F.col("event_id") / 500).alias("cur"), (F.floor(F.col("event_id") / 500) - F.col("event_id") % 3).alias("made")), "cur", "made"))
query("replay_ring", "SELECT event_id % 128 AS slot, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")(lambda spark, sf: stream.ring(_t(spark, sf, "events").select("event_id", "value"), 128, "event_id"))
query("partial_rollout", "WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id, event_id // 1000 AS version, count(*) OVER (PARTITION BY user_id) AS c, event_type FROM events) SELECT user_id AS sample_id, count(*)::INTEGER AS n_parts, min(version) AS version_start, max(version) AS version_end, max(version) - min(version) AS version_span, count(*)::BIGINT AS n_tokens FROM p GROUP BY 1 HAVING bool_or(n = c AND event_type <> 'error')")(
    lambda spark, sf: stream.assemble_partial(_t(spark, sf, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("part_no"), F.array("event_id").alias("tokens"), F.floor(F.col("event_id") / 1000).alias("version"), (F.col("event_type") != "error").alias("finished"))).select("sample_id", "n_parts", "version_start", "version_end", "version_span", F.size("tokens").cast("long").alias("n_tokens"))
)

# the star schema, as Spark plans it ------------------------------------------------------------------------------------------------------
_SQL = {
    "star_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "star_nation_revenue": "SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
    "star_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "star_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "star_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "star_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "star_intersect": "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09",
    "star_except": "SELECT s_suppkey AS k FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07",
    "star_full_outer": "SELECT a.c_nationkey AS x, b.s_nationkey AS y, count(*) AS n FROM customer a FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey < 12) b ON a.c_nationkey = b.s_nationkey GROUP BY 1, 2",
    "star_ranking": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS q FROM orders",
    "star_tumbling": "SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
}
for _name, _text in _SQL.items():

    def _run(spark, sf, text=_text):
        for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events"):
            _t(spark, sf, t).createOrReplaceTempView(t)
        return spark.sql(text)

    query(_name, _text)(_run)
