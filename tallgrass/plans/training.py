"""Catalogue: advantages, token scans, losses, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import masked
from tallgrass.operators import advantage as A
from tallgrass.operators import correction as C
from tallgrass.operators import losses as L
from tallgrass.plans.catalogue import query
from tallgrass.plans.views import LINE_KEY, ROLL, TOK, r6, rollouts, sequences, tokens

_KEY = ", ".join(LINE_KEY)
_W = "WINDOW w AS (PARTITION BY uid)"


def _outcome(name: str, sql: str, fn, digits: int = 4) -> None:
    query(name, f"SELECT {_KEY}, round({sql}, {digits}) + 0.0 AS advantage FROM (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mu, stddev_samp(score) OVER w AS sd, var_samp(score) OVER w AS va FROM ({ROLL}) {_W})")(lambda spark, sf: fn(rollouts(spark, sf)).select(*LINE_KEY, r6("advantage", digits).alias("advantage")))


_CENTRED = "CASE WHEN n = 1 THEN score ELSE score - mu END"
_outcome("adv_dr_grpo", _CENTRED, lambda d: A.grpo(d, by_std=False))
_outcome("adv_grpo_vec", f"({_CENTRED}) / (CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(va, 1e-6)) END + 1e-6)", A.grpo_vectorized)
_outcome("adv_rloo", "CASE WHEN n = 1 THEN score ELSE (score - mu) * n / (n - 1) END", A.rloo)
_outcome("adv_rloo_vec", "CASE WHEN n = 1 THEN 0 ELSE (score - mu) * n / (n - 1) END", A.rloo_vectorized)

query(
    "adv_opo",
    f"SELECT {_KEY}, round(CASE WHEN n = 1 THEN score ELSE score - b END, 4) + 0.0 AS advantage FROM (SELECT *, count(*) OVER w AS n, sum(length * score) OVER w / sum(length) OVER w AS b FROM ({ROLL}) {_W})",
)(lambda spark, sf: A.opo(rollouts(spark, sf)).select(*LINE_KEY, r6("advantage", 4).alias("advantage")))

query(
    "adv_gpg",
    f"""WITH x AS (SELECT * REPLACE ((l_returnflag = 'R')::DOUBLE AS score) FROM ({ROLL}))
    SELECT {_KEY}, round((SELECT count(*) / greatest(sum((score <> 0)::INT), 1) FROM x) * (CASE WHEN n = 1 THEN score ELSE score - mu END), 6) + 0.0 AS advantage
    FROM (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mu FROM x {_W})""",
)(lambda spark, sf: A.gpg(rollouts(spark, sf).withColumn("score", (F.col("l_returnflag") == "R").cast("double"))).select(*LINE_KEY, r6("advantage").alias("advantage")))

query(
    "adv_passk",
    f"""SELECT {_KEY}, round(CASE WHEN rn = 1 THEN (score - nxt) / (sd + 1e-6) ELSE 0 END, 6) + 0.0 AS advantage
    FROM (SELECT *, count(*) OVER w AS n, stddev_samp(score) OVER w AS sd, row_number() OVER o AS rn, lead(score) OVER o AS nxt FROM ({ROLL})
          WINDOW w AS (PARTITION BY uid), o AS (PARTITION BY uid ORDER BY score DESC, {_KEY}))
    WHERE n >= 2""",
)(lambda spark, sf: A.grpo_passk(rollouts(spark, sf).join(rollouts(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("uid"), "uid", "left_semi"), order=LINE_KEY).select(*LINE_KEY, r6("advantage").alias("advantage")))

query(
    "adv_rfpp_baseline",
    f"""WITH x AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN score ELSE score - avg(score) OVER w END AS c FROM ({ROLL}) {_W}),
    s AS (SELECT sum(length) AS n, sum(c * length) AS s, sum(c * c * length) AS q FROM x), t AS (SELECT n, s, q, s / (n + 1e-8) AS m FROM s)
    SELECT {_KEY}, round((c - m) / sqrt((q - 2 * m * s + m * m * n) / (n + 1e-8) * n / (n - 1) + 1e-8), 6) + 0.0 AS advantage FROM x, t""",
)(lambda spark, sf: A.rfpp_baseline(rollouts(spark, sf)).select(*LINE_KEY, r6("advantage").alias("advantage")))


def _exploded(df, *cols):
    z = df.select("row_id", F.posexplode(F.arrays_zip(*cols)).alias("pos", "x"))
    return z.select("row_id", F.col("pos").cast("long").alias("pos"), *[r6(F.col(f"x.{c}")).alias(c) for c in cols])


query(
    "returns_to_go",
    f"SELECT row_id, pos, round(sum(r * m) OVER (PARTITION BY row_id ORDER BY pos DESC), 6) + 0.0 AS returns, round(sum(r * m) OVER (PARTITION BY row_id ORDER BY pos DESC) - 0.5 * m, 6) + 0.0 AS advantages FROM ({TOK})",
)(lambda spark, sf: _exploded(A.remax_frame(sequences(spark, sf).withColumn("reward_baseline", F.lit(0.5))), "returns", "advantages"))

_GAE = """WITH RECURSIVE t AS MATERIALIZED ({tok}), n AS (SELECT row_id, max(pos) AS last FROM t GROUP BY 1),
  g AS (SELECT t.row_id, t.pos, CASE WHEN m <> 0 THEN r - v ELSE 0 END AS lg, CASE WHEN m <> 0 THEN v ELSE 0 END AS nv FROM t JOIN n ON t.row_id = n.row_id AND t.pos = n.last
        UNION ALL
        SELECT t.row_id, t.pos, CASE WHEN t.m <> 0 THEN t.r + 0.99 * g.nv - t.v + 0.99 * 0.95 * g.lg ELSE g.lg END, CASE WHEN t.m <> 0 THEN t.v ELSE g.nv END FROM g JOIN t ON t.row_id = g.row_id AND t.pos = g.pos - 1),
  a AS (SELECT g.row_id, g.pos, lg, lg + t.v AS returns, t.m FROM g JOIN t USING (row_id, pos)),
  s AS (SELECT sum(m) AS n, sum(lg * m) AS s, sum(lg * lg * m) AS q FROM a), w AS (SELECT s / (n + 1e-8) AS mu, n, s, q FROM s)
  SELECT row_id, pos, round((lg - mu) / sqrt((q - 2 * mu * s + mu * mu * n) / (n + 1e-8) * n / (n - 1) + 1e-8), 6) + 0.0 AS advantages, round(returns, 6) + 0.0 AS returns FROM a, w"""
query("gae", _GAE.format(tok=TOK))(lambda spark, sf: _exploded(A.gae_frame(sequences(spark, sf), 0.99, 0.95), "advantages", "returns"))

query(
    "reinforce_pp",
    f"""WITH RECURSIVE t AS MATERIALIZED ({TOK}), n AS (SELECT row_id, max(pos) AS last FROM t GROUP BY 1),
  g AS (SELECT t.row_id, t.pos, t.r AS now, t.m FROM t JOIN n ON t.row_id = n.row_id AND t.pos = n.last
        UNION ALL SELECT t.row_id, t.pos, t.r + 0.9 * g.now * g.m, t.m FROM g JOIN t ON t.row_id = g.row_id AND t.pos = g.pos - 1),
  s AS (SELECT sum(m) AS n, sum(now * m) AS s, sum(now * now * m) AS q FROM g), w AS (SELECT s / (n + 1e-8) AS mu, n, s, q FROM s)
  SELECT row_id, pos, round((now - mu) / sqrt((q - 2 * mu * s + mu * mu * n) / (n + 1e-8) * n / (n - 1) + 1e-8) * m, 6) + 0.0 AS advantages, round(now, 6) + 0.0 AS returns FROM g, w""",
)(lambda spark, sf: _exploded(A.rfpp_frame(sequences(spark, sf), 0.9), "advantages", "returns"))

_OTB = """WITH t AS ({tok}), a AS (SELECT row_id, uid, pos, m, sum(r * m) OVER (PARTITION BY row_id ORDER BY pos DESC) AS g, sum((1 - 2 * exp(logp) + pi2) * m) OVER (PARTITION BY row_id ORDER BY pos) AS w, sum(m) OVER (PARTITION BY row_id) AS len FROM t),
  l AS (SELECT uid, row_id, max(len) AS len FROM a GROUP BY 1, 2), k AS (SELECT uid, count(*) AS rows, max(len) AS l1, coalesce(list_sort(list(len), 'DESC')[2], 0) AS l2 FROM l GROUP BY 1),
  b AS (SELECT *, sum(g * w * m) OVER (PARTITION BY uid, pos) / (sum(w * m) OVER (PARTITION BY uid, pos) + 1e-8) AS base FROM a)
  SELECT row_id, pos, round((g - CASE WHEN rows = 1{tail} THEN 0 ELSE base END) * m, 6) + 0.0 AS advantage FROM b JOIN k USING (uid)"""
query("otb", _OTB.format(tok=TOK, tail=""))(lambda spark, sf: A.otb(tokens(spark, sf)).select("row_id", "pos", r6("advantage").alias("advantage")))
query(
    "tir_otb",
    f"""WITH u AS ({TOK}), z AS (SELECT row_id, uid, pos AS opos, r, m, logp, pi2, row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1 AS pos FROM u WHERE m <> 0),
    x AS ({_OTB.format(tok="SELECT * FROM z", tail=" OR (len = l1 AND l1 > l2 AND pos >= l2)")})
    SELECT u.row_id, u.pos, coalesce(x.advantage, 0.0) AS advantage FROM u LEFT JOIN z ON u.row_id = z.row_id AND u.pos = z.opos LEFT JOIN x ON z.row_id = x.row_id AND z.pos = x.pos""",
)(lambda spark, sf: A.tir_otb(tokens(spark, sf)).select("row_id", "pos", r6("advantage").alias("advantage")))

query("position_ids", f"SELECT row_id, pos, greatest(sum(m) OVER (PARTITION BY row_id ORDER BY pos) - 1, 0)::INTEGER AS position_id FROM ({TOK})")(
    lambda spark, sf: sequences(spark, sf).select("row_id", F.posexplode(masked.position_ids("response_mask")).alias("pos", "position_id")).withColumn("pos", F.col("pos").cast("long"))
)
query("response_mask_until_eos", f"SELECT row_id, pos, (sum((event_id % 9 = 2)::INT) OVER (PARTITION BY row_id ORDER BY pos) - (event_id % 9 = 2)::INT = 0)::INTEGER AS response_mask FROM ({TOK})")(
    lambda spark, sf: tokens(spark, sf).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("event_id") % 9).alias("t")))).alias("x")).select("row_id", F.posexplode(masked.response_mask_to_eos(F.col("x.t"), 2)).alias("pos", "response_mask")).withColumn("pos", F.col("pos").cast("long"))
)
for _kind, _sql in (("k1", "d"), ("abs", "abs(d)"), ("k2", "0.5 * d * d"), ("k3", "least(greatest(exp(least(greatest(-d, -20), 20)) - least(greatest(-d, -20), 20) - 1, -10), 10)")):
    query(f"kl_{_kind}", f"SELECT row_id, pos, round({_sql}, 6) + 0.0 AS kl FROM (SELECT *, logp - ref AS d FROM ({TOK}))")(lambda spark, sf, k=_kind: tokens(spark, sf).select("row_id", "pos", r6(A.kl_penalty(F.col("logp"), F.col("ref"), k)).alias("kl")))
query("kl_reward", f"SELECT row_id, pos, round(r - 0.1 * (old - ref), 6) + 0.0 AS reward FROM ({TOK})")(
    lambda spark, sf: sequences(spark, sf).select("row_id", F.posexplode(A.kl_reward("token_level_rewards", "old", "ref", 0.1)).alias("pos", "reward")).select("row_id", F.col("pos").cast("long").alias("pos"), r6("reward").alias("reward"))
)


def _one(df):
    """A single row, every number rounded."""
    return df.select(*[r6(c).alias(c) for c in df.columns])


def _agg(loss: str, mode: str) -> str:
    if mode == "token-mean":
        return f"sum(({loss}) * m) / sum(m)"
    return {"seq-mean-token-sum": "sum(s) FILTER (n > 0) / count(*) FILTER (n > 0)", "seq-mean-token-mean": "sum(s / (n + 1e-8)) FILTER (n > 0) / count(*) FILTER (n > 0)", "seq-mean-token-sum-norm": "sum(s) / max(width)"}[mode]


def _loss_sql(pre: str, loss: str, mode: str, extra: dict[str, str]) -> str:
    """pre: columns to compute first."""
    cols = ", ".join(f"sum(({e}) * m) AS x_{k}" for k, e in extra.items())
    value = _agg("loss", mode) if mode != "token-mean" else "sum(s) / sum(n)"
    outer = "".join(f", round(sum(x_{k}) / (sum(n) + 1e-8), 6) + 0.0 AS {k}" for k in extra)
    return f"SELECT round({value}, 6) + 0.0 AS loss{outer} FROM (SELECT row_id, sum(({loss}) * m) AS s, sum(m) AS n, count(*) AS width{', ' + cols if cols else ''} FROM (SELECT *{', ' + pre if pre else ''} FROM (SELECT *, least(greatest(logp - old, -20), 20) AS d FROM ({TOK}))) GROUP BY row_id)"


_CLIP = "least(greatest(exp(d), 0.8), 1.2)"
for _mode in L.MODES:
    query(f"loss_vanilla_{_mode.replace('-', '_')}", _loss_sql("", f"CASE WHEN adv < 0 THEN least(-adv * 3, greatest(-adv * exp(d), -adv * {_CLIP})) ELSE greatest(-adv * exp(d), -adv * {_CLIP}) END", _mode, {"clipfrac": f"(-adv * {_CLIP} > -adv * exp(d))::INT", "ppo_kl": "-d", "clipfrac_lower": f"(greatest(-adv * exp(d), -adv * {_CLIP}) > -adv * 3 AND adv < 0)::INT"}))(lambda spark, sf, m=_mode: _one(L.vanilla(tokens(spark, sf), m)))
query("loss_gspo", _loss_sql("sum(d * m) OVER (PARTITION BY row_id) / greatest(sum(m) OVER (PARTITION BY row_id), 1) AS q", "greatest(-adv * exp(least(q, 10)), -adv * least(greatest(exp(least(q, 10)), 0.8), 1.2))", "seq-mean-token-mean", {"clipfrac": "(-adv * least(greatest(exp(least(q, 10)), 0.8), 1.2) > -adv * exp(least(q, 10)))::INT", "ppo_kl": "-q"}))(lambda spark, sf: _one(L.gspo(tokens(spark, sf))))
query("loss_sapo", _loss_sql("CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END AS tau", "-(1 / (1 + exp(-tau * (exp(d) - 1)))) * 4 / tau * adv", "seq-mean-token-mean", {"ppo_kl": "-d"}))(lambda spark, sf: _one(L.sapo(tokens(spark, sf))))
query("loss_gpg", _loss_sql("", "-logp * adv", "token-mean", {}))(lambda spark, sf: _one(L.gpg(tokens(spark, sf))))
query("loss_cispo", _loss_sql("", f"-{_CLIP} * adv * logp", "token-mean", {"clipfrac": f"(exp(d) <> {_CLIP})::INT", "ppo_kl": "-d"}))(lambda spark, sf: _one(L.cispo(tokens(spark, sf))))
query("loss_reinforce", _loss_sql("", "-adv * logp", "seq-mean-token-sum", {"kl": "old - logp"}))(lambda spark, sf: _one(L.reinforce(tokens(spark, sf))))
query(
    "loss_geo_mean",
    f"""SELECT round(avg(-exp(d / (n + 1e-8)) * a / (n + 1e-8)), 6) + 0.0 AS loss, round(sum(c) / (sum(n) + 1e-8), 6) + 0.0 AS clipfrac, round(sum(k) / (sum(n) + 1e-8), 6) + 0.0 AS ppo_kl
    FROM (SELECT row_id, sum(m) AS n, sum(g * m) AS d, sum(adv * m) AS a, sum((g <> x)::INT * m) AS c, sum(-x * m) AS k
          FROM (SELECT *, sign(adv) * least(sign(adv) * x, sign(adv) * least(greatest(x, -0.2), 0.2)) AS g FROM (SELECT *, logp - old AS x FROM ({TOK}))) GROUP BY row_id)""",
)(lambda spark, sf: _one(L.geo_mean(tokens(spark, sf))))
query(
    "loss_kl_cov",
    f"""WITH t AS ({TOK}), mu AS (SELECT sum(adv * m) / (sum(m) + 1e-8) AS a, sum(logp * m) / (sum(m) + 1e-8) AS l, greatest(1, floor(sum(m) * 0.01)) AS k FROM t),
    c AS (SELECT t.*, row_number() OVER (ORDER BY CASE WHEN m <> 0 THEN (adv - a) * (logp - l) END DESC NULLS LAST, row_id, pos) AS rk, k FROM t, mu)
    SELECT round(sum((-adv * exp(logp - old) + CASE WHEN rk <= k AND m <> 0 THEN abs(logp - old) ELSE 0 END) * m) / sum(m), 6) + 0.0 AS loss, round(sum(abs(logp - old) * m) / (sum(m) + 1e-8), 6) + 0.0 AS ppo_kl FROM c""",
)(lambda spark, sf: _one(L.kl_cov(tokens(spark, sf), ratio=0.01)))
query("loss_clip_cov")(lambda spark, sf: _one(L.clip_cov(tokens(spark, sf), ratio=0.01, low=0.01)))
query("loss_value", _loss_sql("least(greatest(vpred, v - 0.5), v + 0.5) AS cut", "0.5 * greatest((vpred - ret) ** 2, (cut - ret) ** 2)", "token-mean", {"clipfrac": "((cut - ret) ** 2 > (vpred - ret) ** 2)::INT"}))(lambda spark, sf: _one(L.value_loss(tokens(spark, sf))))
query("loss_entropy", _loss_sql("", "entropy", "token-mean", {}))(lambda spark, sf: _one(L.entropy_loss(tokens(spark, sf))))
query(
    "loss_composite",
    f"""SELECT round(p, 6) + 0.0 AS pg_loss, round(e, 6) + 0.0 AS entropy_loss, round(k, 6) + 0.0 AS kl_loss, round(p - 0.01 * e + 0.1 * k, 6) + 0.0 AS loss
    FROM (SELECT sum(-logp * adv * m) / sum(m) AS p, sum(entropy * m) / sum(m) AS e, sum((logp - ref) * m) / sum(m) AS k FROM ({TOK}))""",
)(lambda spark, sf: _one(L.composite(tokens(spark, sf), "gpg", entropy_coef=0.01, kl=F.col("logp") - F.col("ref"), kl_coef=0.1).select("pg_loss", "entropy_loss", "kl_loss", "loss")))

_X = "least(greatest(old - roll, -20), 20)"
query("is_token", f"SELECT row_id, pos, round(least(exp({_X}) * m, 1.1), 6) + 0.0 AS rho FROM ({TOK})")(lambda spark, sf: C.importance_weights(tokens(spark, sf), "token", 1.1).select("row_id", "pos", r6("rho").alias("rho")))
query("is_sequence", f"SELECT row_id, pos, round(least(exp(least(greatest(sum((old - roll) * m) OVER (PARTITION BY row_id), -20), 20)) * m, 2.0), 6) + 0.0 AS rho FROM ({TOK})")(lambda spark, sf: C.importance_weights(tokens(spark, sf), "sequence").select("row_id", "pos", r6("rho").alias("rho")))
query("is_token_normalized", f"SELECT row_id, pos, round(w / (SELECT sum(least(exp({_X}) * m, 1.1) * m) / sum(m) FROM ({TOK})), 6) + 0.0 AS rho FROM (SELECT row_id, pos, least(exp({_X}) * m, 1.1) AS w FROM ({TOK}))")(lambda spark, sf: C.importance_weights(tokens(spark, sf), "token", 1.1, True).select("row_id", "pos", r6("rho").alias("rho")))
_STATS = {"k1": f"-({_X})", "k2": f"0.5 * ({_X}) * ({_X})", "k3": f"exp({_X}) - 1 - ({_X})"}
_BOUNDS = {"token": "0.85_1.2", "seq_sum": "0.3_3.5", "seq_mean": "0.97_1.03", "seq_max": "0.02"}
for _option in C.OPTIONS:
    _level, _k = _option.rsplit("_", 1)
    _lo, _, _hi = ("0_" + _BOUNDS[_level]).rpartition("_") if _level == "seq_max" else _BOUNDS[_level].partition("_")
    _spec = f"{_lo.split('_')[-1]}_{_hi}" if _k == "k1" else {"token": "0.01", "seq_sum": "0.6", "seq_mean": "0.01", "seq_max": "0.02"}[_level]
    _e = _STATS[_k]
    _s = {"token": _e, "seq_sum": f"sum(({_e}) * m) OVER (PARTITION BY row_id)", "seq_mean": f"sum(({_e}) * m) OVER (PARTITION BY row_id) / (sum(m) OVER (PARTITION BY row_id) + 1e-8)", "seq_max": f"max(CASE WHEN m <> 0 THEN {_e} END) OVER (PARTITION BY row_id)"}[_level]
    _ok = f"s BETWEEN ln({_lo}) AND ln({_hi})" if _k == "k1" else f"s <= {_spec}"
    query(f"rs_{_option}", f"SELECT row_id, sum(m)::BIGINT AS n, sum(CASE WHEN coalesce({_ok}, true) THEN m ELSE 0 END)::BIGINT AS kept FROM (SELECT *, {_s} AS s FROM ({TOK})) GROUP BY row_id")(lambda spark, sf, o=_option, t=_spec: C.reject(tokens(spark, sf), o, t).groupBy("row_id").agg(F.sum("m").alias("n"), F.sum("keep").cast("long").alias("kept")))

query(
    "offpolicy_metrics",
    f"""WITH rows AS (SELECT row_id, sum(old * m) / (sum(m) + 1e-8) AS t, sum(roll * m) / (sum(m) + 1e-8) AS r, sum(m) AS n, sum((old - roll) * m) AS s, sum((roll - old) * m) AS k1, sum((exp(old - roll) - (old - roll) - 1) * m) AS k3, sum(exp(2 * ({_X})) * m) AS c FROM ({TOK}) GROUP BY row_id)
    SELECT round(avg(exp(-t)), 6) + 0.0 AS training_ppl, round(avg(-t), 6) + 0.0 AS training_log_ppl, round(avg(exp(-r)), 6) + 0.0 AS rollout_ppl, round(avg(-r), 6) + 0.0 AS rollout_log_ppl,
      round(avg(r - t), 6) + 0.0 AS log_ppl_diff, round(avg(abs(r - t)), 6) + 0.0 AS log_ppl_abs_diff, round(max(r - t), 6) + 0.0 AS log_ppl_diff_max, round(min(r - t), 6) + 0.0 AS log_ppl_diff_min, round(avg(exp(r - t)), 6) + 0.0 AS ppl_ratio,
      round(sum(k1) / (sum(n) + 1e-8), 6) + 0.0 AS kl, round(sum(k3) / (sum(n) + 1e-8), 6) + 0.0 AS k3_kl, round(sum(c) / (sum(n) + 1e-8) - 1, 6) + 0.0 AS chi2_token, round(avg(exp(2 * least(greatest(s, -20), 20))) - 1, 6) + 0.0 AS chi2_seq FROM rows""",
)(lambda spark, sf: _one(C.offpolicy_metrics(tokens(spark, sf))))
query(
    "is_metrics",
    f"""SELECT round(avg(w), 6) + 0.0 AS is_mean, round(max(w), 6) + 0.0 AS is_max, round(min(w), 6) + 0.0 AS is_min, round(avg((w > 1.2)::INT), 6) + 0.0 AS is_high, round(avg((w < 1 / 1.2::DOUBLE)::INT), 6) + 0.0 AS is_low, round(stddev_pop(h), 6) + 0.0 AS is_std, round(avg(h) * avg(h) / avg(h * h), 6) + 0.0 AS is_ess
    FROM (SELECT w, greatest(least(w, 1.2), 1 / 1.2::DOUBLE) AS h FROM (SELECT exp({_X}) AS w FROM ({TOK}) WHERE m <> 0))""",
)(lambda spark, sf: _one(C.is_metrics(tokens(spark, sf), 1.2)))
query("debug_probs_corr", f"SELECT round(max(abs(a - b)), 6) + 0.0 AS diff_max, round(avg(abs(a - b)), 6) + 0.0 AS diff_mean, round(stddev_samp(abs(a - b)), 6) + 0.0 AS diff_std, round(corr(a, b), 6) + 0.0 AS pearson FROM (SELECT exp(roll) AS a, exp(old) AS b FROM ({TOK}) WHERE m <> 0)")(lambda spark, sf: _one(C.probability_difference(tokens(spark, sf))))
query("pf_ppo_weights", "SELECT event_id, round(greatest(value ** 2 + 1e-8, 1e-8), 4) + 0.0 AS weight FROM events")(lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").transform(lambda d: A.pf_ppo_weights(d, "value")).select("event_id", r6("weight", 4).alias("weight")))
query("pf_ppo_resample")(lambda spark, sf: (lambda d: A.pf_ppo_resample(d, d.count(), "event_id", "value").select("draw", "event_id"))(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")))
