"""Advantage estimators. Outcome estimators give each rollout (uid, score) a number that is spread over its tokens; the others fold over tokens.

All estimators of a group share one window over uid, so Spark deals the rows once. Global moments come from one aggregate whose single row is joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.masked import kept, mask_sum, total
from tallgrass.sources.durable import durable

_REGISTRY: dict[str, Callable] = {}


def _group():
    """The window of a prompt's rollouts."""
    return Window.partitionBy("uid")


def register(name: str) -> Callable[[Callable], Callable]:
    """A second, different function under one name is refused."""

    def put(fn: Callable) -> Callable:
        if _REGISTRY.get(name, fn) is not fn:
            raise ValueError(f"advantage estimator {name} is taken")
        _REGISTRY[name] = fn
        return fn

    return put


def get(name: str) -> Callable:
    if name not in _REGISTRY:
        raise ValueError(f"unknown advantage estimator {name}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def _stats(score: Column) -> tuple[Column, Column, Column]:
    return F.count(F.lit(1)).over(_group()), F.avg(score).over(_group()), F.stddev_samp(score).over(_group())


@register("grpo")
def grpo(df: DataFrame, epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(score - mean) / (std + epsilon) inside a group; a group of one has mean 0 and std 1."""
    n, mean, sd = _stats(F.col("score"))
    adv = F.when(n == 1, F.col("score")).otherwise(F.col("score") - mean)
    return df.withColumn("advantage", adv / (F.coalesce(sd, F.lit(1.0)) + epsilon) if by_std else adv)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """The same with a floor of epsilon under the variance."""
    n, mean, _ = _stats(F.col("score"))
    var = F.var_samp("score").over(_group())
    adv = F.when(n == 1, F.col("score")).otherwise(F.col("score") - mean)
    sd = F.when(n == 1, F.lit(1.0)).otherwise(F.sqrt(F.greatest(var, F.lit(epsilon))))
    return df.withColumn("advantage", adv / (sd + epsilon) if by_std else adv)


@register("grpo_passk")
def grpo_passk(df: DataFrame, epsilon: float = 1e-6, by_std: bool = True, order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Only a group's best row gets something: its lead over the second. Ties go to the first in `order`; groups of one raise."""
    ranked = Window.partitionBy("uid").orderBy(F.desc("score"), *order)
    n, _, sd = _stats(F.col("score"))
    lead = F.col("score") - F.lead("score").over(ranked)
    best = F.row_number().over(ranked) == 1
    adv = F.when(n < 2, F.raise_error(F.lit("pass@k needs two rollouts of every prompt")).cast("double")).when(best, lead / (sd + epsilon) if by_std else lead).otherwise(0.0)
    return df.withColumn("advantage", adv)


@register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """Score less the mean of the others; a group of one keeps its score."""
    n, mean, _ = _stats(F.col("score"))
    return df.withColumn("advantage", F.when(n == 1, F.col("score")).otherwise((F.col("score") - mean) * n / (n - 1)))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """The same, but 0 in a group of one."""
    n, mean, _ = _stats(F.col("score"))
    return df.withColumn("advantage", F.when(n == 1, F.lit(0.0)).otherwise((F.col("score") - mean) * n / (n - 1)))


@register("opo")
def opo(df: DataFrame) -> DataFrame:
    """Score less the mean weighted by `length`; the baseline of a group of one is 0."""
    n = F.count(F.lit(1)).over(_group())
    base = F.sum(F.col("length") * F.col("score")).over(_group()) / F.sum("length").over(_group())
    return df.withColumn("advantage", F.when(n == 1, F.col("score")).otherwise(F.col("score") - base))


@register("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (score - mean) / f_norm with alpha = rows / rows whose score isn't 0, over the whole batch."""
    n, mean, _ = _stats(F.col("score"))
    alpha = df.agg((F.count(F.lit(1)) / F.greatest(F.sum((F.col("score") != 0).cast("long")), F.lit(1))).alias("_alpha"))
    centred = F.when(n == 1, F.col("score")).otherwise(F.col("score") - mean)
    return df.withColumn("_centred", centred).crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("_alpha") * F.col("_centred") / f_norm).drop("_alpha", "_centred")


@register("reinforce_plus_plus_baseline")
def rfpp_baseline(df: DataFrame) -> DataFrame:
    """Score less the group mean, whitened over all tokens: each row weighs as much as its `length`."""
    n, mean, _ = _stats(F.col("score"))
    rows = df.withColumn("_x", F.when(n == 1, F.col("score")).otherwise(F.col("score") - mean))
    moments = rows.agg(F.sum("length").alias("_n"), F.sum(F.col("_x") * F.col("length")).alias("_s"), F.sum(F.col("_x") * F.col("_x") * F.col("length")).alias("_q"))
    m = F.col("_s") / (F.col("_n") + 1e-8)
    var = (F.col("_q") - 2 * m * F.col("_s") + m * m * F.col("_n")) / (F.col("_n") + 1e-8) * F.col("_n") / (F.col("_n") - 1)
    return rows.crossJoin(F.broadcast(moments)).withColumn("advantage", (F.col("_x") - m) / F.sqrt(var + 1e-8)).drop("_x", "_n", "_s", "_q")


def spread(advantage: Column | str, mask: Column | str) -> Column:
    """A row's advantage on its tokens."""
    a = F.col(advantage) if isinstance(advantage, str) else advantage
    return F.transform(mask, lambda m: a * m)


def gae(rewards: Column | str, values: Column | str, mask: Column | str, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Raw advantages of one row, from last token to first; masked tokens hand the next value and the running advantage on."""
    z = F.reverse(F.arrays_zip(F.col(rewards).alias("r"), F.col(values).alias("v"), F.col(mask).alias("m")))
    zero = F.struct(F.lit(0.0).alias("nv"), F.lit(0.0).alias("lg"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        used = x["m"] != 0
        g = x["r"] + gamma * a["nv"] - x["v"] + gamma * lam * a["lg"]
        lg = F.when(used, g).otherwise(a["lg"])
        return F.struct(F.when(used, x["v"]).otherwise(a["nv"]).alias("nv"), lg.alias("lg"), F.array_append(a["out"], lg).alias("out"))

    return F.reverse(F.aggregate(z, zero, step, lambda a: a["out"]))


def discounted(rewards: Column | str, mask: Column | str, gamma: float = 1.0) -> Column:
    """Discounted return of each token, taken up afresh behind a masked one."""
    z = F.reverse(F.arrays_zip(F.col(rewards).alias("r"), F.col(mask).alias("m")))
    zero = F.struct(F.lit(0.0).alias("R"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        now = x["r"] + gamma * a["R"]
        return F.struct((now * x["m"]).alias("R"), F.array_append(a["out"], now).alias("out"))

    return F.reverse(F.aggregate(z, zero, step, lambda a: a["out"]))


def whiten(df: DataFrame, values: str, mask: str, out: str = "advantages", shift: bool = True) -> DataFrame:
    """Array column `values` by mean and variance of all unmasked tokens; fewer than two of those raise."""
    x, n = kept(values, mask), mask_sum(mask)
    squares = total(F.zip_with(F.col(values), F.col(mask), lambda v, m: F.when(m != 0, v * v * m).otherwise(F.lit(0.0))))
    one = df.select(n.alias("n"), total(x).alias("s"), squares.alias("q")).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    m = F.col("_s") / (F.col("_n") + 1e-8)
    var = (F.col("_q") - 2 * m * F.col("_s") + m * m * F.col("_n")) / (F.col("_n") + 1e-8) * F.col("_n") / (F.col("_n") - 1)
    one = one.select(m.alias("_mean"), F.when(F.col("_n") < 2, F.raise_error(F.lit("whitening needs two unmasked tokens")).cast("double")).otherwise(var).alias("_var"))
    white = F.transform(values, lambda v: (v - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8) + (F.lit(0.0) if shift else F.col("_mean")))
    return df.crossJoin(F.broadcast(one)).withColumn(out, white).drop("_mean", "_var")


@register("gae")
def gae_frame(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Adds advantages (whitened) and returns (raw advantage + value)."""
    raw = df.withColumn("_raw", gae("token_level_rewards", "values", "response_mask", gamma, lam))
    raw = raw.withColumn("returns", F.zip_with("_raw", "values", lambda a, v: a + v))
    return whiten(raw, "_raw", "response_mask").drop("_raw")


@register("reinforce_plus_plus")
def rfpp_frame(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    raw = df.withColumn("returns", discounted("token_level_rewards", "response_mask", gamma))
    white = whiten(raw, "returns", "response_mask")
    return white.withColumn("advantages", F.zip_with("advantages", "response_mask", lambda a, m: a * m))


@register("remax")
def remax_frame(df: DataFrame) -> DataFrame:
    """Reward to go less the greedy rollout's score (column reward_baseline)."""
    raw = df.withColumn("returns", F.reverse(_running(F.reverse(kept("token_level_rewards", "response_mask")))))
    return raw.withColumn("advantages", F.zip_with("returns", "response_mask", lambda g, m: g - F.col("reward_baseline") * m))


def _running(x: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(x, zero, lambda a, v: F.struct((a["s"] + v).alias("s"), F.array_append(a["out"], a["s"] + v).alias("out")), lambda a: a["out"])


def otb_tokens(tok: DataFrame, epsilon: float = 1e-8, zero_tail: bool = False) -> DataFrame:
    """Optimal token baseline on a flat token view (row_id, uid, pos, r, m, logp, pi2 and, optionally, rho): adds advantage and returns. A position's baseline is the mean of returns weighted by accumulated token variance over the group; groups of one have none."""
    by_row = Window.partitionBy("row_id").orderBy("pos")
    ahead = by_row.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = 1 - 2 * F.exp("logp") + F.col("pi2")
    if "rho" in tok.columns:
        w = w * F.col("rho") * F.col("rho")
    tok = tok.withColumn("returns", F.sum(F.col("r") * F.col("m")).over(ahead)).withColumn("_w", F.sum(w * F.col("m")).over(behind))
    tok = tok.withColumn("_len", F.sum("m").over(Window.partitionBy("row_id")))
    at = Window.partitionBy("uid", "pos")
    base = F.sum(F.col("returns") * F.col("_w") * F.col("m")).over(at) / (F.sum(F.col("_w") * F.col("m")).over(at) + epsilon)
    rows = tok.select("uid", "row_id", "_len").distinct()
    group = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("_rows"), F.array_sort(F.collect_list("_len")).alias("_lens"))
    longest, second = F.element_at("_lens", -1), F.try_element_at("_lens", F.lit(-2))
    group = group.select("uid", "_rows", longest.alias("_longest"), F.coalesce(second, F.lit(0.0)).alias("_second"))
    tok = tok.withColumn("_base", base).join(group, "uid")
    tail = (F.col("_len") == F.col("_longest")) & (F.col("_longest") > F.col("_second")) & (F.col("pos") >= F.col("_second"))
    b = F.when((F.col("_rows") == 1) | (tail if zero_tail else F.lit(False)), F.lit(0.0)).otherwise(F.col("_base"))
    return tok.withColumn("advantage", (F.col("returns") - b) * F.col("m")).drop("_w", "_len", "_base", "_rows", "_longest", "_second")


@register("optimal_token_baseline")
def otb(tok: DataFrame, **kwargs) -> DataFrame:
    return otb_tokens(tok, **kwargs)


@register("tir_optimal_token_baseline")
def tir_otb(tok: DataFrame, zero_tail: bool = True, epsilon: float = 1e-8) -> DataFrame:
    """The same over turns: unmasked tokens are moved together before positions are compared, masked ones get 0."""
    w = Window.partitionBy("row_id").orderBy("pos")
    used = tok.where("m <> 0").withColumn("_pos", F.col("pos")).withColumn("pos", F.row_number().over(w) - 1)
    out = otb_tokens(used, epsilon, zero_tail).withColumn("pos", F.col("_pos")).drop("_pos")
    rest = tok.where("m = 0").withColumn("returns", F.lit(0.0)).withColumn("advantage", F.lit(0.0))
    return out.unionByName(rest)


def pf_ppo_weights(rows: DataFrame, score: str = "score", method: str = "pow", power: float = 2.0) -> DataFrame:
    """Adds weight, by which rows are drawn again. Extremes come from one aggregate row."""
    if method not in ("pow", "max_min", "max_random"):
        raise ValueError(f"unknown reweight method {method}")
    x = F.col(score)
    if method == "pow":
        return rows.withColumn("weight", F.greatest(F.pow(F.abs(x), F.lit(power)) + 1e-8, F.lit(1e-8)))
    ends = rows.agg(F.max(x).alias("_top"), F.min(x).alias("_low"))
    w = F.when((x == F.col("_top")) | (x == F.col("_low")), 1.0).otherwise(0.0) if method == "max_min" else F.when(x == F.col("_top"), 0.4).otherwise(0.1)
    return rows.crossJoin(F.broadcast(ends)).withColumn("weight", F.greatest(w + 1e-8, F.lit(1e-8))).drop("_top", "_low")


def pf_ppo_resample(rows: DataFrame, n: int, order: str, score: str = "score", method: str = "pow", power: float = 2.0, seed: int = 0) -> DataFrame:
    """n rows drawn with replacement by weight: draw i falls at a seeded place of the sum of weights and takes the row that covers it. Ranges of rows are summed where they lie; only their sums reach the driver."""
    weighted = durable(pf_ppo_weights(rows, score, method, power).repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "pf-ppo")
    sums = sorted((r._p, r.w) for r in weighted.groupBy("_p").agg(F.sum("weight").alias("w")).collect())
    if not sums:
        return rows.withColumn("draw", F.lit(0).cast("long")).limit(0)
    total, offsets = 0.0, []
    for p, w in sums:
        offsets.append((p, total, total + w))
        total += w
    spark = rows.sparkSession
    ranges = F.broadcast(spark.createDataFrame(offsets, "_p int, _from double, _to double"))
    hashed = F.pmod(F.xxhash64(F.lit(seed), "draw"), F.lit(1 << 52)) / float(1 << 52)
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("_at", hashed * total)
    draws = draws.join(ranges, (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    until = F.sum("weight").over(Window.partitionBy("_p").orderBy(order))
    covered = weighted.withColumn("_until", until).join(ranges.select("_p", "_from"), "_p").select(*rows.columns, "weight", "_p", (F.col("_from") + F.col("_until")).alias("_end"))
    # each draw takes the first row of its range that ends behind it: one order of rows and draws, from the end
    one = F.struct(*rows.columns, "weight")
    both = covered.select("_p", F.col("_end").alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("draw"), one.alias("x"))
    both = both.unionByName(draws.select("_p", F.col("_at").alias("_pos"), F.lit(0).alias("_kind"), "draw"), allowMissingColumns=True)
    w = Window.partitionBy("_p").orderBy(F.desc("_pos"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("x", F.last("x", ignorenulls=True).over(w)).where("draw IS NOT NULL").select("draw", "x.*")


def kl_reward(score: Column | str, logp: Column | str, ref: Column | str, beta: float) -> Column:
    """Token rewards less beta times the log ratio."""
    return F.zip_with(score, F.zip_with(logp, ref, lambda a, b: a - b), lambda s, k: s - beta * k)


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    """Forward value of a KL estimate; a trailing + (straight-through gradient) changes nothing here."""
    kind = kind.removesuffix("+")
    d = logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        x = F.greatest(F.least(-d, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(x) - x - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"unknown KL penalty {kind}")


class AdaptiveKL:
    """A coefficient that follows a target."""

    def __init__(self, coef: float, target: float, horizon: float):
        self.value, self.target, self.horizon = coef, target, horizon

    def update(self, kl: float, steps: int) -> None:
        self.value *= 1 + min(max(kl / self.target - 1, -0.2), 0.2) * steps / self.horizon


class FixedKL:
    def __init__(self, coef: float):
        self.value = coef

    def update(self, kl: float, steps: int) -> None:
        pass
