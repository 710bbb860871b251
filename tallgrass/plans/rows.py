"""Catalogue: files, prepared rows, batch metrics, reward managers, graders by source, and rollout bookkeeping."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tallgrass.functions import graders
from tallgrass.operators import correction, losses, metrics, prep, rewards
from tallgrass.plans.catalogue import query
from tallgrass.plans.views import TOK, r6, tokens
from tallgrass.sources import files
from tallgrass.sources.durable import shared_dir
from tallgrass.streaming import rollouts as stream

_CONV = "conv_id long, turn long, role string, text string"


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sql(spark, sf, text, *names):
    """Spark's reading of an SQL text over tables, named without views."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in names:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **{name: _t(spark, sf, name) for name in names})


def _new_path(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df, keep=()):
    return df.select(*[F.col(c) if c in keep else r6(F.col(c).cast("double")).alias(c) for c in df.columns])


def _in_sql(columns, keep=()):
    """The same rounding in SQL, of (name, expression) pairs."""
    return ", ".join(f"{e} AS {n}" if n in keep else f"round(({e})::DOUBLE, 6) + 0.0 AS {n}" for n, e in columns)


# files -----------------------------------------------------------------------------------------------------------------------------------


@query("scan_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def scan_jsonl(spark, sf):
    """Rows written as lines, with blank lines between them, and read again."""
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path = _new_path(spark, "lines")
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.select(F.explode(F.array("value", F.lit(""))).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, _CONV)


@query("scan_jsonl_ok", "SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 1")
def scan_jsonl_ok(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 1, "ok").otherwise("error").alias("reasoning_status"))
    path = files.write_jsonl(rows, _new_path(spark, "reasoning"))
    return files.read_jsonl(spark, path, "doc_id long, lang string, reasoning_status string", F.col("reasoning_status") == "ok").drop("reasoning_status")


@query("scan_corpus", "SELECT page_id::VARCHAR AS id, url || ' ' || length(html) AS contents FROM pages")
def scan_corpus(spark, sf):
    rows = _t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.concat("url", F.lit(" "), F.length("html")).alias("contents"))
    return files.read_jsonl(spark, files.write_jsonl(rows, _new_path(spark, "corpus")), "id string, contents string")


@query("scan_sft", "SELECT doc_id, lang AS prompt_text, source AS response_text FROM documents")
def scan_sft(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.struct(F.struct(F.col("lang").alias("question"), F.col("source").alias("answer")).alias("inner")).alias("extra_info"))
    stored = spark.read.parquet(files.write_parquet(rows, _new_path(spark, "sft")))
    return files.prompt_response(stored, ["extra_info", "inner", "question"], ["extra_info", "inner", "answer"]).drop("extra_info")


_DUMP = "SELECT turn AS step, role AS input, text AS output, conv_id::VARCHAR AS gts, turn * 0.5 AS score, length(text) AS n FROM conversations"


@query("dump_generations", f"SELECT step, input, regexp_replace(output, '[0-9]+', '*', 'g') AS output, gts, score::DOUBLE AS score, n::BIGINT AS n FROM ({_DUMP})")
def dump_generations(spark, sf):
    rows = _sql(spark, sf, _DUMP.replace("::VARCHAR", "::string"), "conversations").withColumn("score", F.col("score").cast("double"))
    path = files.dump_generations(rows, _new_path(spark, "dump"), ["n"])
    back = files.browse_dumps(spark, path, "input string, output string, gts string, score double, n long, step long", "[0-9]+")
    return back.select("step", "input", "output", "gts", "score", "n")


_STEPS = "SELECT event_id % 50 AS step, event_type AS name, value FROM events"


@query("metric_file", f"SELECT step, name, max(value) AS value FROM ({_STEPS}) GROUP BY 1, 2")
def metric_file(spark, sf):
    long = _sql(spark, sf, _STEPS, "events").groupBy("step", "name").agg(F.max("value").alias("value"))
    path = files.write_jsonl(files.metric_lines(long), _new_path(spark, "metrics"))
    back = files.read_jsonl(spark, path, "step long, data map<string,double>")
    return back.select("step", F.explode("data").alias("name", "value"))


@query("console_line", f"SELECT step, 'step:' || step || string_agg(' - ' || name || ':' || n, '' ORDER BY name) AS line FROM (SELECT step, name, count(*) AS n FROM ({_STEPS}) GROUP BY 1, 2) GROUP BY step")
def console_line(spark, sf):
    long = _sql(spark, sf, _STEPS, "events").groupBy("step", "name").agg(F.count("*").alias("value"))
    return long.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("m")).select("step", files.console_line(F.col("step"), F.col("m")).alias("line"))


@query("flatten_fields", 'SELECT o_orderkey AS "a/key", o_orderstatus AS "a/b/status", o_custkey AS c FROM orders')
def flatten_fields(spark, sf):
    rows = _t(spark, sf, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status")).alias("b")).alias("a"), F.col("o_custkey").alias("c"))
    return rows.select(*files.flatten_fields(rows.schema))


_KEYS = "SELECT p_partkey, 'val@' || (p_partkey % 7) || '//' || p_name || '#(' || p_brand || ')' AS name FROM part"


@query("sanitized_key", f"SELECT p_partkey, regexp_replace(regexp_replace(replace(name, '@', '_at_'), '/+', '/', 'g'), '[^/A-Za-z0-9_.\\- :]', '_', 'g') AS name FROM ({_KEYS})")
def sanitized_key(spark, sf):
    return _sql(spark, sf, _KEYS, "part").select("p_partkey", files.sanitized_key(F.col("name")).alias("name"))


@query("computed_once", "SELECT l_suppkey, count(*) AS n, 1::INTEGER AS times_made FROM lineitem GROUP BY 1")
def computed_once(spark, sf):
    made = []

    def make():
        made.append(1)
        return _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))

    path = f"{_new_path(spark, 'once')}/{files.cache_key('exp', 'a/b', 64, 8)}"
    files.computed_once(spark, path, make)
    return files.computed_once(spark, path, make).withColumn("times_made", F.lit(len(made)))


@query("offline_responses", "SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS responses FROM events GROUP BY 1")
def offline_responses(spark, sf):
    out = files.with_responses(_t(spark, sf, "events"), "user_id", "event_id", "event_type")
    return out.select("user_id", F.array_join("responses", "|").alias("responses"))


# prepared rows ---------------------------------------------------------------------------------------------------------------------------
_GSM = "SELECT doc_id, 'Q' || n_chars || '?' AS question, 'so ' || lang || ' #### ' || (n_chars // 7) || ',' || (doc_id % 90 + 10) || ' and #### 3' AS answer FROM documents"
_GSM_TRUTH = "(n_chars // 7) || (doc_id % 90 + 10)"


def _gsm(spark, sf):
    return _sql(spark, sf, _GSM.replace("//", "div"), "documents")


query("prep_first_answer", f"SELECT doc_id, {_GSM_TRUTH} AS answer FROM documents")(lambda spark, sf: _gsm(spark, sf).select("doc_id", prep.first_answer(F.col("answer")).alias("answer")))
query("prep_chat_rows", f"SELECT doc_id, unnest(['user', 'assistant']) AS role, unnest([question, answer]) AS content FROM ({_GSM})")(
    lambda spark, sf: _gsm(spark, sf).select("doc_id", F.explode(prep.chat_rows(F.col("question"), F.col("answer"))).alias("m")).select("doc_id", "m.role", "m.content")
)


@query("prep_agent_rows", f"SELECT doc_id, 'openai/gsm8k' AS data_source, 'tool_agent' AS agent_name, 'system' AS first_role, question, {_GSM_TRUTH.replace('n_chars', 'd.n_chars').replace('doc_id', 'd.doc_id')} AS ground_truth, true AS need_tools_kwargs FROM ({_GSM}) g JOIN documents d USING (doc_id)")
def prep_agent_rows(spark, sf):
    rows = _gsm(spark, sf).withColumn("truth", prep.first_answer(F.col("answer")))
    out = rows.select("doc_id", *prep.agent_row(F.lit("openai/gsm8k"), F.col("question"), F.col("truth"), "train", F.col("doc_id"), "Use the tool.", "tool_agent", "calc"))
    truth = F.col("extra_info.tools_kwargs.calc.create_kwargs.ground_truth")
    return out.select("doc_id", "data_source", "agent_name", F.col("prompt")[0]["role"].alias("first_role"), F.col("prompt")[1]["content"].alias("question"), truth.alias("ground_truth"), F.col("extra_info.need_tools_kwargs").alias("need_tools_kwargs"))


@query("prep_interaction_rows", f"SELECT doc_id, 'gsm8k' AS name, question AS query, {_GSM_TRUTH.replace('n_chars', 'd.n_chars').replace('doc_id', 'd.doc_id')} AS ground_truth FROM ({_GSM}) g JOIN documents d USING (doc_id)")
def prep_interaction_rows(spark, sf):
    rows = _gsm(spark, sf).withColumn("truth", prep.first_answer(F.col("answer")))
    out = rows.select("doc_id", *prep.interaction_row(F.lit("openai/gsm8k"), F.col("question"), F.col("truth"), "train", F.col("doc_id"), "Think.", "gsm8k"))
    return out.select("doc_id", "extra_info.interaction_kwargs.name", "extra_info.interaction_kwargs.query", "extra_info.interaction_kwargs.ground_truth")


@query("prep_image_rows", "SELECT page_id, url || ' Answer in a box.' AS content, url || '.png' AS image, page_id::VARCHAR AS ground_truth, 'test' AS split FROM pages")
def prep_image_rows(spark, sf):
    images = F.array(F.struct(F.concat("url", F.lit(".png")).alias("image")))
    out = _t(spark, sf, "pages").select("page_id", *prep.image_row(F.lit("geo"), F.col("url"), images, F.col("page_id").cast("string"), "test", F.col("page_id"), "Answer in a box."))
    return out.select("page_id", F.col("prompt")[0]["content"].alias("content"), F.col("images")[0]["image"].alias("image"), "reward_model.ground_truth", "extra_info.split")


def _with_videos(spark, sf):
    """Documents with a video or none, and messages."""
    video = F.struct(F.col("source").alias("video"), F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 100).cast("int")).alias("max_frames"))
    videos = F.when(F.col("doc_id") % 5 > 0, F.array(video)).otherwise(F.array().cast("array<struct<video:string,max_frames:int>>"))
    return _t(spark, sf, "documents").select("doc_id", videos.alias("videos"), F.array(prep.message("system", F.lit("s")), prep.message("user", F.concat(F.when(F.col("doc_id") % 2 == 0, "<video>").otherwise(""), F.col("lang")))).alias("prompt"))


query("prep_sample_key", "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS video, CASE WHEN doc_id % 2 = 0 THEN '<video>' ELSE '' END || lang AS content FROM documents")(
    lambda spark, sf: _with_videos(spark, sf).select("doc_id", prep.sample_key(F.col("videos"), F.col("prompt")).alias("k")).select("doc_id", "k.video", "k.content")
)
query("prep_cap_frames", "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN least(doc_id % 100, 64) ELSE 64 END::INTEGER AS max_frames FROM documents WHERE doc_id % 5 > 0")(
    lambda spark, sf: _with_videos(spark, sf).select("doc_id", F.explode(prep.cap_frames(F.col("videos"), 64)).alias("v")).select("doc_id", "v.max_frames")
)
query("prep_reasoning", "SELECT doc_id, 3::INTEGER AS n, 'why ' || doc_id AS last FROM documents")(
    lambda spark, sf: _with_videos(spark, sf).select("doc_id", prep.with_reasoning(F.col("prompt"), F.concat(F.lit("why "), F.col("doc_id"))).alias("m")).select("doc_id", F.size("m").alias("n"), F.element_at("m", -1)["content"].alias("last"))
)
query("prep_has_vision", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0")(lambda spark, sf: _with_videos(spark, sf).where(prep.has_vision(F.col("prompt"))).select("doc_id"))
query("prep_video_frames", "SELECT event_id, greatest(least(CASE WHEN event_id % 2 = 0 THEN event_id % 40 ELSE floor(2.0 * (event_id % 300) / 7.0)::INTEGER END, 32), 4)::INTEGER AS n FROM events")(
    lambda spark, sf: _t(spark, sf, "events").select("event_id", prep.video_frames(F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 40).cast("int")), F.lit(None).cast("double"), (F.col("event_id") % 300) / 7.0, 4, 32).alias("n"))
)
query("prep_label_not_empty", "SELECT doc_id FROM documents WHERE length(text) > 0")(lambda spark, sf: _t(spark, sf, "documents").where(F.length("text") > 0).select("doc_id"))
query("prep_head_rows", "SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY event_id) <= 100")(
    lambda spark, sf: prep.head_rows(_numbered(spark, sf, "events", "event_id"), 100).select("event_id")
)
query("prep_random_split")(lambda spark, sf: prep.random_split(_t(spark, sf, "documents").select("doc_id"), "doc_id", 0.1))
query("prep_sampled_rows")(lambda spark, sf: (lambda d: prep.sampled_rows(d, d.count(), 64).select("event_id", "pick"))(_numbered(spark, sf, "events", "event_id")))


def _numbered(spark, sf, name, key):
    from tallgrass.operators import batch

    return batch.number(_t(spark, sf, name), key)


query("prep_preferences", "SELECT o_orderkey, [o_custkey, o_orderkey % 7] AS chosen, 2::INTEGER AS n FROM orders".replace("[o_custkey, o_orderkey % 7] AS chosen", "o_custkey || ',' || (o_orderkey % 7) AS chosen"))(
    lambda spark, sf: _t(spark, sf, "orders").select("o_orderkey", prep.stacked_preferences(F.array("o_custkey", F.col("o_orderkey") % 7), F.array("o_orderkey")).alias("x")).select("o_orderkey", F.array_join(F.col("x")[0].cast("array<string>"), ",").alias("chosen"), F.size("x").alias("n"))
)
#: Ids 1 and 2 begin a turn, 3 ends it; each customer's orders make one sequence.
_MARK = "SELECT o_custkey AS k, o_orderkey AS place, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 ELSE 9 END AS id FROM orders"


@query(
    "marker_mask",
    f"""WITH s AS (SELECT *, row_number() OVER w AS p, id = 2 AND lag(id) OVER w = 1 AS begins FROM ({_MARK}) WINDOW w AS (PARTITION BY k ORDER BY place)),
        e AS (SELECT *, sum((id = 3)::INT) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn, max(CASE WHEN id = 3 THEN p END) OVER (PARTITION BY k) AS last_end FROM s),
        b AS (SELECT *, min(CASE WHEN begins THEN p END) OVER (PARTITION BY k, coalesce(turn, 0)) AS first_begin FROM e)
        SELECT k, count(*) AS n, sum((first_begin IS NOT NULL AND p > first_begin AND id <> 3 AND p < last_end)::INT)::BIGINT AS trained FROM b GROUP BY k""",
)
def marker_mask(spark, sf):
    seqs = _sql(spark, sf, _MARK, "orders").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("x"))
    mask = prep.marker_mask(F.col("x.id"), [1, 2], 3)
    return seqs.select("k", F.size("x").cast("long").alias("n"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, v: a + v).alias("trained"))


_LABEL = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '00' || (event_id % 9) WHEN 1 THEN (event_id % 9)::VARCHAR WHEN 2 THEN 'g' || (event_id % 9) ELSE (event_id % 9) || '.0000000' END AS label FROM events"
query("label_key", f"SELECT key, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 2 THEN label ELSE (event_id % 9)::VARCHAR END AS key FROM (SELECT event_id, label FROM ({_LABEL}))) GROUP BY 1")(
    lambda spark, sf: _sql(spark, sf, _LABEL.replace("::VARCHAR", "::string"), "events").groupBy(prep.label_key(F.col("label")).alias("key")).agg(F.count("*").alias("n"))
)

# metrics ---------------------------------------------------------------------------------------------------------------------------------
_BATCH = "SELECT o_orderkey AS row_id, o_totalprice / 1000 AS score, o_totalprice / 1500 AS reward, o_custkey % 700 AS prompt_length, o_orderkey % 50 AS response_length, o_orderkey % 6 AS num_turns, o_custkey % 4 AS tool_calls FROM orders"
_ADV = f"SELECT m, adv, r AS ret, v FROM ({TOK})"
_THREE = (("mean", "avg"), ("max", "max"), ("min", "min"))


def _batch(spark, sf):
    return _sql(spark, sf, _BATCH, "orders")


_M = [(f"{p}_{n}", f"{f}({c}){w}") for p, c, w in (("score", "score", " FILTER (response_length > 0)"), ("rewards", "reward", " FILTER (response_length > 0)"), ("response_length", "response_length", ""), ("response_length_non_aborted", "response_length", " FILTER (response_length > 0)"), ("prompt_length", "prompt_length", ""), ("num_turns", "num_turns", ""), ("tool_call_counts", "tool_calls", "")) for n, f in _THREE]
_M += [("response_length_clip_ratio", "avg((response_length = 49)::INT)"), ("response_length_non_aborted_clip_ratio", "avg((response_length = 49)::INT) FILTER (response_length > 0)"), ("prompt_length_clip_ratio", "avg((prompt_length = 699)::INT)"), ("aborted_ratio", "avg((response_length = 0)::INT)")]
_N = [(f"{p}_{n}", f"{f}({c})") for p, c in (("advantages", "adv"), ("returns", "ret"), ("values", "v")) for n, f in _THREE] + [("vf_explained_var", "1 - var_samp(ret - v) / (var_samp(ret) + 1e-5)")]


@query("batch_metrics", f"SELECT * FROM (SELECT {_in_sql(_M)} FROM ({_BATCH})), (SELECT {_in_sql(_N)} FROM ({_ADV}) WHERE m <> 0)")
def batch_metrics(spark, sf):
    return _rounded(metrics.batch_metrics(_batch(spark, sf), tokens(spark, sf).withColumn("ret", F.col("r")), 49, 699))


_TIMES = {"gen": 2.5, "ref": 1.25, "adv": 0.5, "save": 3.0}


@query("timing_metrics", "WITH t AS (SELECT sum(prompt_length) AS p, sum(response_length) AS r FROM (" + _BATCH + "))" + " UNION ALL ".join([f" SELECT 'timing_s/{k}' AS name, {v}::DOUBLE AS value" for k, v in _TIMES.items()] + [f" SELECT 'timing_per_token_ms/{k}', round({v} * 1000 / {'r' if k == 'gen' else '(p + r)'}, 9) FROM t" for k, v in _TIMES.items() if k != "save"]))
def timing_metrics(spark, sf):
    return metrics.timing_metrics(_batch(spark, sf), _TIMES).select("name", F.round("value", 9).alias("value"))


query("throughput", f"SELECT sum(prompt_length + response_length)::BIGINT AS total_num_tokens, 12.5::DOUBLE AS time_per_step, round(sum(prompt_length + response_length) / 100.0, 6)::DOUBLE AS throughput FROM ({_BATCH})")(
    lambda spark, sf: metrics.throughput(_batch(spark, sf), 12.5, 8).withColumn("throughput", r6("throughput"))
)
_W = "(1 - 2 * exp(old) + pi2)"


def _variance_sql(weight):
    row = f"SELECT row_id, sum(CASE WHEN m <> 0 THEN adv ELSE 0 END) / (sum(m) + 1e-8) AS a, sum(CASE WHEN m <> 0 THEN {_W} * {weight} * {weight} ELSE 0 END) AS w, sum(CASE WHEN m <> 0 THEN {_W} ELSE 0 END) AS w0, sum(CASE WHEN m <> 0 THEN {weight} ELSE 0 END) / (sum(m) + 1e-8) AS iw FROM ({TOK}) GROUP BY 1"
    power = "avg(iw * iw * a * a * greatest(w0, 0))" if weight != "1.0" else "avg(a * a * greatest(w, 0))"
    return f"SELECT 0.25::DOUBLE AS signal_strength, round({power}, 5) + 0.0 AS total_power, round(greatest(({power} - 0.25) / (count(*) - 1), 0), 5) + 0.0 AS pure_noise, round(avg(a * a), 5) + 0.0 AS expected_a_squared, round(avg(w), 5) + 0.0 AS expected_w FROM ({row})"


def _variance(spark, sf, weights):
    out = metrics.variance_proxies(tokens(spark, sf).withColumn("iw", F.col("v") + 0.5), 0.5, weights)
    return out.select(*[r6(c, 5).alias(c) for c in out.columns])


query("variance_proxies", _variance_sql("1.0"))(partial(_variance, weights=None))
query("variance_proxies_weighted", _variance_sql("(v + 0.5)"))(partial(_variance, weights="iw"))
query("spread", "SELECT round(avg(value), 6) + 0.0 AS mean, max(value) AS max, min(value) AS min, round(stddev_samp(value), 6) + 0.0 AS std FROM events")(
    lambda spark, sf: metrics.spread(_t(spark, sf, "events"), "value").select(r6("mean").alias("mean"), "max", "min", r6("std").alias("std"))
)
query("with_prefix", "SELECT 'train/' || event_type AS name, count(*) AS value FROM events GROUP BY 1")(
    lambda spark, sf: metrics.with_prefix(_t(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value")), "train/")
)
_AGENT = "SELECT event_id AS row_id, value AS generate_sequences, (event_id % 9)::DOUBLE AS tool_calls, event_id % 3 AS num_preempted, event_id % 100 AS prompt_length, event_id % 77 AS response_length FROM events"
_AG = ("num_preempted", "generate_sequences", "tool_calls")


@query("agent_timing", "SELECT * FROM (SELECT " + _in_sql([(f"{c}_{n}", f"{f}({c})") for c in _AG for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))]) + f" FROM ({_AGENT})), (SELECT " + _in_sql([(f"slowest_{c}", c) for c in (*_AG, "prompt_length", "response_length")]) + f" FROM ({_AGENT}) ORDER BY generate_sequences + tool_calls DESC, row_id LIMIT 1)")
def agent_timing(spark, sf):
    return _rounded(metrics.agent_timing(_sql(spark, sf, _AGENT.replace("::DOUBLE", "::double"), "events")))


@query("derived_async", 'SELECT user_id, round(max(value) - min(value), 6) + 0.0 AS "minmax_diff", round(count(*) / (sum(value + 1) * 4), 6) + 0.0 AS throughput, round(min(value + 1) / max(value + 1), 6) + 0.0 AS idle_ratio FROM events GROUP BY 1')
def derived_async(spark, sf):
    v = F.col("value")
    cols = {"global_seqlen/max": F.max(v), "global_seqlen/min": F.min(v), "perf/total_num_tokens": F.count("*"), "perf/time_per_step": F.sum(v + 1), "timing_s/gen": F.min(v + 1), "timing_s/step": F.max(v + 1)}
    wide = metrics.derived_async(_t(spark, sf, "events").groupBy("user_id").agg(*[x.alias(k) for k, x in cols.items()]), 4)
    return wide.select("user_id", *[r6(F.col(f"`{c}`")).alias(c.split("/")[1]) for c in ("global_seqlen/minmax_diff", "perf/throughput", "trainer/idle_ratio")])


_VAL = "SELECT o_orderpriority AS data_source, o_custkey AS uid, o_orderkey AS pos, CASE o_orderkey % 2 WHEN 0 THEN 'reward' ELSE 'acc' END AS variable, o_totalprice / 7 AS value, o_orderstatus AS pred FROM orders"
_VAL_SQL = f"""WITH r AS ({_VAL}), p AS (SELECT data_source, uid, variable, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM r GROUP BY 1, 2, 3),
    v AS (SELECT data_source, uid, variable, pred, count(*) AS c, min(pos) AS p0, arg_min(value, pos) AS first FROM r GROUP BY 1, 2, 3, 4),
    j AS (SELECT data_source, uid, variable, first AS maj FROM v QUALIFY row_number() OVER (PARTITION BY data_source, uid, variable ORDER BY c DESC, p0) = 1),
    l AS (SELECT data_source, variable, 'mean@' || n AS metric, mean AS value FROM p UNION ALL SELECT data_source, variable, 'std@' || n, std FROM p WHERE n > 1 UNION ALL SELECT p.data_source, p.variable, 'maj@' || n, maj FROM p JOIN j USING (data_source, uid, variable) WHERE n > 1)
    SELECT data_source, variable, metric, round(avg(value), 4) + 0.0 AS value FROM l GROUP BY 1, 2, 3"""


def _validated(df):
    return df.select("data_source", "variable", "metric", r6("value", 4).alias("value"))


query("validation_metrics", _VAL_SQL)(lambda spark, sf: _validated(metrics.validation_metrics(_sql(spark, sf, _VAL, "orders"), True)))
query("merge_validation", _VAL_SQL.replace("row_number() OVER (PARTITION BY data_source, uid, variable ORDER BY c DESC, p0)", "row_number() OVER (PARTITION BY data_source, uid, variable ORDER BY c DESC, p0)"))(
    lambda spark, sf: (lambda r: _validated(metrics.merge_validation(r.where("pos % 2 = 0"), r.where("pos % 2 = 1"), True)))(_sql(spark, sf, _VAL, "orders"))
)

# losses and corrections ------------------------------------------------------------------------------------------------------------------
query("loss_supervised", f"SELECT round(-sum(logp) FILTER (after <> 0) / (SELECT sum(m) FROM ({TOK})), 6) + 0.0 AS loss FROM (SELECT logp, coalesce(lead(m) OVER (PARTITION BY row_id ORDER BY pos), 0) AS after FROM ({TOK}))")(
    lambda spark, sf: losses.supervised(tokens(spark, sf)).select(r6("loss").alias("loss"))
)


def _clip_sql():
    d = "least(greatest(logp - old, -20), 20)"
    one, two = f"-adv * exp({d})", f"-adv * least(greatest(exp({d}), 0.8), 1.2)"
    each = f"greatest({one}, {two})"
    return f"SELECT round(sum(CASE WHEN adv < 0 THEN least({each}, -adv * 3.0) ELSE {each} END) FILTER (m <> 0) / sum(m), 6) + 0.0 AS loss FROM ({TOK})"


query("loss_clipped_ratio", _clip_sql())(lambda spark, sf: losses.clipped_ratio(tokens(spark, sf)).select(r6("loss").alias("loss")))


@query("token_mismatches", "SELECT user_id, count(*) FILTER (event_id % 7 <> event_id % 5 AND event_type <> 'error') AS n FROM events GROUP BY 1")
def token_mismatches(spark, sf):
    rows = _t(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.struct((F.col("event_id") % 7).alias("a"), (F.col("event_id") % 5).alias("b"), (F.col("event_type") != "error").cast("int").alias("m"))).alias("x"))
    return rows.select("user_id", correction.mismatches(F.col("x.a"), F.col("x.b"), F.col("x.m")).alias("n"))


def _option_sql(kind, lo, hi, two, seq):
    x = "least(greatest(old - roll, -20), 20)"
    s = {"k1": f"-({x})", "k2": f"0.5 * {x} * {x}", "k3": f"exp({x}) - 1 - {x}"}[kind]
    stat = f"SELECT row_id, m, {s} AS s FROM ({TOK}) WHERE m <> 0"
    if seq:
        stat = f"SELECT row_id, m, sum(s) OVER (PARTITION BY row_id) / (count(*) OVER (PARTITION BY row_id) + 1e-8) AS s FROM ({stat})"
    n, low = "(count(*) + 1e-8)", f"(s < {lo})::INT" if two else "0"
    held = f"greatest(least(s, {hi}), {lo if two else 0.0})"
    per = [("mean", f"sum(s) / {n}"), ("max", "max(s)"), ("min", "min(s)"), ("std", f"sqrt(greatest(sum({held} * {held}) / {n} - (sum({held}) / {n}) * (sum({held}) / {n}), 0))")]
    of_seq = [("seq_mean", "avg(s)"), ("seq_std", "stddev_samp(s)"), ("seq_max", "max(s)"), ("seq_min", "min(s)"), ("seq_max_deviation", "max(abs(s))"), ("seq_fraction_high", f"avg((s > {hi})::INT)"), ("seq_fraction_low", f"avg({low})")]
    both = [("fraction_high", f"avg((s > {hi})::INT)"), ("fraction_low", f"avg({low})")] if seq else [("fraction_high", f"sum((s > {hi})::INT) / {n}"), ("fraction_low", f"sum({low}) / {n}")]
    seqs = f"SELECT row_id, sum(s) / (count(*) + 1e-8) AS s FROM ({stat}) GROUP BY 1"
    head = f"SELECT {_in_sql(per if seq else per + both)} FROM ({stat})"
    return f"SELECT * FROM ({head}), (SELECT {_in_sql(of_seq + (both if seq else []))} FROM ({seqs}))"


query("rs_metrics_token_k3", _option_sql("k3", 0.0, 0.02, False, False))(lambda spark, sf: _rounded(correction.option_metrics(tokens(spark, sf), "token_k3", 0.02)))
query("rs_metrics_token_k1", _option_sql("k1", "ln(0.8)", "ln(1.25)", True, False))(lambda spark, sf: _rounded(correction.option_metrics(tokens(spark, sf), "token_k1", "0.8_1.25")))
query("rs_metrics_seq_mean_k2", _option_sql("k2", 0.0, 0.04, False, True))(lambda spark, sf: _rounded(correction.option_metrics(tokens(spark, sf), "seq_mean_k2", 0.04)))

# graders ---------------------------------------------------------------------------------------------------------------------------------
#: Solutions from the tables' own words: the first words of a document's text in a box, judged by the first words of its neighbour by position.
_LABELLED = "SELECT doc_id, lower(lang) || ', ' || source || CASE doc_id % 3 WHEN 0 THEN ', x' ELSE '' END AS guess, lang || ',' || CASE doc_id % 2 WHEN 0 THEN source ELSE 'src1' END AS truth FROM documents"


def _boxed(spark, sf, text=_LABELLED):
    rows = _sql(spark, sf, text, "documents")
    return rows.withColumn("sol", F.concat(F.when(F.col("doc_id") % 5 > 0, "<think>t</think> ").otherwise(""), F.lit("\\boxed{"), "guess", F.lit("} end")))


_SETS = f"SELECT doc_id, list_distinct(list_transform(string_split(guess, ','), lambda x: upper(trim(x)))) AS p, list_distinct(list_transform(string_split(truth, ','), lambda x: upper(trim(x)))) AS t, (doc_id % 5 > 0)::INT AS fmt FROM ({_LABELLED})"
_PARTS = f"SELECT doc_id, (len(list_intersect(p, t)) = len(p) AND len(p) = len(t))::INT AS acc, len(list_intersect(p, t)) / len(list_distinct(p || t)) AS jaccard, 2.0 * len(list_intersect(p, t)) / (len(p) + len(t)) AS f1, len(list_intersect(p, t)) / len(p) AS precision, len(list_intersect(p, t)) / len(t) AS recall, fmt AS format FROM ({_SETS})"
_FIELDS = ("score", "acc", "jaccard", "f1", "precision", "recall", "format")


@query("grade_tactile_fields", f"SELECT doc_id, {_in_sql([('score', '0.5 * acc + 0.4 * jaccard + 0.1 * format'), *[(f, f) for f in _FIELDS[1:]]])} FROM ({_PARTS})")
def grade_tactile_fields(spark, sf):
    rows = _boxed(spark, sf).select("doc_id", graders.tactile(F.col("sol"), F.col("truth")).alias("g"))
    return rows.select("doc_id", *[r6(f"g.{f}").alias(f) for f in _FIELDS])


_WORDY = "SELECT doc_id, ' ' || lang || ' ' || source || CASE doc_id % 3 WHEN 0 THEN ' Joy' ELSE '' END AS guess, CASE doc_id % 4 WHEN 0 THEN ' ' ELSE '' END || lang || ' ' || source AS truth FROM documents"
_TOKENS = f"SELECT doc_id, lower(guess) = lower(truth) AS same, list_distinct(list_filter(string_split(lower(guess), ' '), lambda x: x <> '')) AS p, list_distinct(list_filter(string_split(lower(truth), ' '), lambda x: x <> '')) AS t, (doc_id % 5 > 0)::INT AS fmt FROM ({_WORDY})"


@query("grade_behaviour_fields", f"SELECT doc_id, {_in_sql([('acc', 'same::INT'), ('jaccard', 'len(list_intersect(p, t)) / len(list_distinct(p || t))'), ('f1', '2.0 * len(list_intersect(p, t)) / (len(p) + len(t))'), ('precision', 'len(list_intersect(p, t)) / len(p)'), ('recall', 'len(list_intersect(p, t)) / len(t)'), ('format', 'fmt')])} FROM ({_TOKENS})")
def grade_behaviour_fields(spark, sf):
    rows = _boxed(spark, sf, _WORDY).select("doc_id", graders.human_behaviour(F.col("sol"), F.col("truth")).alias("g"))
    return rows.select("doc_id", *[r6(f"g.{f}").alias(f) for f in ("acc", "jaccard", "f1", "precision", "recall", "format")])


@query("grade_qa_subem_tags", "SELECT doc_id, CASE WHEN contains(source, 'src' || (doc_id % 4)) THEN 1.0 ELSE 0.0 END::DOUBLE AS sub, CASE WHEN source = 'src' || (doc_id % 4) THEN CASE WHEN doc_id % 13 > 10 THEN 0.25 ELSE 1.0 END ELSE 0.0 END::DOUBLE AS exact FROM documents")
def grade_qa_subem_tags(spark, sf):
    """Up to twelve answers, of which the last counts: above ten an exact match is worth a quarter, a substring is not."""
    sol = F.concat(F.repeat(F.lit("<answer>no</answer>"), (F.col("doc_id") % 13).cast("int")), F.lit("<answer>The "), "source", F.lit("</answer>"))
    rows = _t(spark, sf, "documents").withColumn("sol", F.when(F.col("doc_id") % 13 == 10, F.replace(sol, F.lit("<answer>no</answer>"), F.lit(""))).otherwise(sol))
    golden = F.array(F.concat(F.lit("src"), (F.col("doc_id") % 4).cast("string")))
    return rows.select("doc_id", graders.qa_score(F.col("sol"), golden, True).alias("sub"), graders.qa_score(F.col("sol"), golden).alias("exact"))


query("grade_strict_box", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 3)::VARCHAR END AS pred FROM documents")(
    lambda spark, sf: _t(spark, sf, "documents")
    .select("doc_id", F.concat(F.lit("\\boxed{"), (F.col("doc_id") % 3).cast("string"), F.lit("}"), F.repeat(F.lit("."), F.when(F.col("doc_id") % 2 == 0, 50).otherwise(120))).alias("sol"))
    .select("doc_id", graders.strict_box(F.col("sol"), F.lit("0")).alias("g")).select("doc_id", "g.score", "g.pred")
)
_MATH = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '\\frac12' WHEN 1 THEN '0.5' WHEN 2 THEN '50\\%' WHEN 3 THEN '1/2' ELSE '0.25' END AS guess FROM documents"


@query("grade_math_forms", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS same_form, CASE WHEN doc_id % 5 <> 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS same_value, CASE WHEN doc_id % 5 <> 4 THEN 0.9 ELSE 0.0 END::DOUBLE AS geometry FROM documents")
def grade_math_forms(spark, sf):
    """One half, written in several ways: as text in one form, and by value."""
    rows = _sql(spark, sf, _MATH.replace("\\", "\\\\"), "documents").select("doc_id", F.concat(F.lit("so \\boxed{"), "guess", F.lit("}")).alias("sol"))
    half = F.lit("\\frac{1}{2}")
    return rows.select("doc_id", graders.math_score("sol", half).alias("same_form"), graders.numeric_score("sol", half).alias("same_value"), r6(graders.geometry(F.col("sol"), half)).alias("geometry"))


_SOURCED = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'openai/gsm8k' WHEN 1 THEN 'lighteval/MATH' WHEN 2 THEN 'aime2024' WHEN 3 THEN 'numina_cn_k12' WHEN 4 THEN 'searchR1_nq' ELSE 'hiyouga/geometry3k' END AS data_source, CASE doc_id % 6 WHEN 0 THEN 'it is #### ' || (doc_id % 4) WHEN 2 THEN 'Answer: ' || (doc_id % 4) WHEN 4 THEN '<answer>' || (doc_id % 4) || '</answer>' ELSE 'so \\boxed{' || (doc_id % 4) || '}' END AS sol FROM documents"


@query("grade_by_source", f"SELECT doc_id, data_source, CASE WHEN doc_id % 4 = 2 THEN CASE WHEN data_source LIKE 'hiyouga%' THEN 0.9 ELSE 1.0 END WHEN data_source LIKE 'aime%' THEN -1.0 ELSE 0.0 END::DOUBLE AS score FROM ({_SOURCED})")
def grade_by_source(spark, sf):
    rows = _sql(spark, sf, _SOURCED.replace("\\", "\\\\"), "documents")
    return rows.select("doc_id", "data_source", r6(graders.default_score(F.col("data_source"), F.col("sol"), F.lit("2"))).alias("score"))


# reward managers -------------------------------------------------------------------------------------------------------------------------
_SCORED = "SELECT doc_id, 'it is #### ' || (doc_id % 4) AS sol, (doc_id % 3)::VARCHAR AS truth, (doc_id % 8)::INTEGER AS length, 8::INTEGER AS width FROM documents"
_GOOD = "(doc_id % 4 = doc_id % 3)::INT::DOUBLE"
_SLOT = "CASE WHEN doc_id % 8 = 0 THEN 8 ELSE doc_id % 8 END::BIGINT"


def _scored(spark, sf):
    return _sql(spark, sf, _SCORED.replace("VARCHAR", "string").replace("INTEGER", "int"), "documents")


def _grade():
    return graders.gsm8k_score(F.col("sol"), F.col("truth"))


def _sum_and_slot(df, *extra):
    """The sum of a reward, and where it stands if there is any."""
    slot = F.array_position(F.transform("reward", lambda x: x != 0), True)
    return df.select("doc_id", *extra, r6(F.aggregate("reward", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.when(slot > 0, slot).alias("slot"))


query("reward_naive", f"SELECT doc_id, {_GOOD} AS total, CASE WHEN {_GOOD} > 0 THEN {_SLOT} END AS slot FROM documents")(lambda spark, sf: _sum_and_slot(rewards.manager("naive")(_scored(spark, sf), _grade)))
query("reward_dapo", f"SELECT doc_id, round({_GOOD} + least(-(doc_id % 8 - 4) / 2.0, 0), 6) + 0.0 AS total, round(least(-(doc_id % 8 - 4) / 2.0, 0), 6)::DOUBLE + 0.0 AS overlong_reward, doc_id % 8 > 4 AS overlong FROM documents")(
    lambda spark, sf: _sum_and_slot(rewards.manager("dapo")(_scored(spark, sf), _grade, 6, 2), r6("overlong_reward").alias("overlong_reward"), "overlong").drop("slot")
)
query("reward_precomputed", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 4.0 ELSE {_GOOD} END::DOUBLE AS total FROM documents")(
    lambda spark, sf: _sum_and_slot(rewards.manager("precomputed")(_scored(spark, sf).withColumn("rm_scores", F.when(F.col("doc_id") % 5 == 0, F.array_repeat(F.lit(0.5), 8))), _grade)).drop("slot")
)
query("reward_batch", f"SELECT doc_id, {_GOOD} AS total FROM documents")(
    lambda spark, sf: _sum_and_slot(rewards.manager("batch")(_scored(spark, sf), lambda a, b: (a.str[-1] == b).astype(float), "sol", "truth")).drop("slot")
)
query("reward_tool_calls", "SELECT event_id, CASE WHEN event_id % 3 > coalesce(lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id), 0) THEN 0.0 ELSE -0.05 END::DOUBLE AS reward FROM events")(
    lambda spark, sf: _t(spark, sf, "events").withColumn("r", (F.col("event_id") % 3).cast("double")).select("event_id", rewards.improved_only(None, "user_id", "event_id", "r").alias("reward"))
)
query("rate_limit")(
    lambda spark, sf: rewards.token_bucket(_t(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp("ts").cast("double").alias("at"), (F.col("event_id") % 5 + 1).alias("need")), "user_id", "at", "event_id", "need", 0.01, 4.0).select("user_id", "event_id", r6("allowed").alias("allowed"))
)

# rollouts --------------------------------------------------------------------------------------------------------------------------------
query("stream_feed", "WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, count(*) OVER () AS n FROM customer) SELECT c_custkey, 'sample_' || e || '_' || (e * n + row_id + 1) AS sample_id, k::INTEGER AS copy FROM c, range(2) t(e), range(3) u(k)")(
    lambda spark, sf: stream.feed(_numbered(spark, sf, "customer", "c_custkey"), 3, 2).select("c_custkey", "sample_id", "copy")
)
_BUMP = "SELECT event_id AS version, event_id % 5 AS active, event_id % 3 AS cancelled, event_id % 7 AS queued, 10.0 AS started, CASE WHEN event_id % 2 = 0 THEN 12.0 + event_id % 4 END AS idle_since, 20.0 AS moment FROM events"
query("stream_version_bumps", f"SELECT version, active + cancelled + queued AS staleness, round(1 - (idle_since - started)::DOUBLE / (moment - started)::DOUBLE, 6) + 0.0 AS idle_ratio FROM ({_BUMP})")(
    lambda spark, sf: stream.version_bumps(_sql(spark, sf, _BUMP, "events").withColumns({c: F.col(c).cast("double") for c in ("started", "idle_since", "moment")}).withColumnRenamed("moment", "at")).select("version", "staleness", r6("idle_ratio").alias("idle_ratio"))
)
query("stream_syncs", "SELECT event_id AS step, event_id // 4 AS version FROM events WHERE event_id % 4 = 0")(lambda spark, sf: stream.syncs(_t(spark, sf, "events").select(F.col("event_id").alias("step")), 4))
query("stream_requeued", "WITH p AS (SELECT user_id AS sample_id, count(*) AS n, min(event_id // 1000) AS version_start, max(event_id // 1000) AS version_end, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) SELECT sample_id, n::INTEGER AS n, version_start, version_end FROM p WHERE last = 'error'")(
    lambda spark, sf: stream.requeued(_t(spark, sf, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("part_no"), F.array("event_id").alias("tokens"), F.floor(F.col("event_id") / 1000).alias("version"), (F.col("event_type") != "error").alias("finished"))).select("sample_id", F.size("tokens").alias("n"), "version_start", "version_end")
)


def _ring(spark, sf):
    return stream.ring(_t(spark, sf, "events").select("event_id", "value"), 128, "event_id")


query("replay_resized", "WITH s AS (SELECT event_id % 128 AS slot, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT slot, event_id, value FROM s UNION ALL SELECT i, NULL, NULL FROM range(128, 160) t(i)")(lambda spark, sf: stream.resized(_ring(spark, sf), 128, 160))
query("replay_shrunk", "SELECT event_id % 128 AS slot, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING slot < 100")(lambda spark, sf: stream.resized(_ring(spark, sf), 128, 100))
query("replay_sample")(lambda spark, sf: stream.replay_sample(_ring(spark, sf), 32, 7))
