"""Policy, value and KL losses as aggregates of a flat token view: row_id, m, logp, old, adv and, where used, rho (importance weight), v, ret, vpred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def register(name: str) -> Callable[[Callable], Callable]:
    """The last function registered under a name counts."""

    def put(fn: Callable) -> Callable:
        _REGISTRY[name] = fn
        return fn

    return put


def get(name: str) -> Callable[..., DataFrame]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown policy loss {name}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def clamp(x: Column, lo: float | None, hi: float | None) -> Column:
    y = x if hi is None else F.least(x, F.lit(hi))
    return F.when(F.isnan(x), x).otherwise(y if lo is None else F.greatest(y, F.lit(lo)))


def used(x: Column) -> Column:
    """Times the mask, 0 where it is 0."""
    return F.when(F.col("m") != 0, x * F.col("m")).otherwise(0.0)


def agg_loss(tok: DataFrame, loss: Column, mode: str = "token-mean", extra: dict[str, Column] | None = None, factor: float | None = None, dp_size: int = 1) -> DataFrame:
    """One row: loss by the mode, and masked means of `extra`. Rows without an unmasked token don't count as sequences."""
    if mode not in MODES:
        raise ValueError(f"unknown loss aggregation {mode}")
    extra = extra or {}
    # tokens meet their rows once, with partial sums; the second level has a row for each sequence
    rows = tok.groupBy("row_id").agg(F.sum(used(loss)).alias("s"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("width"), *[F.sum(used(c)).alias(f"x_{k}") for k, c in extra.items()])
    seqs = F.sum((F.col("n") > 0).cast("long"))
    if mode == "token-mean":
        value = F.sum("s") / F.sum("n") * dp_size
    elif mode == "seq-mean-token-sum":
        value = F.sum(F.when(F.col("n") > 0, F.col("s"))) / seqs * dp_size
    elif mode == "seq-mean-token-mean":
        value = F.sum(F.when(F.col("n") > 0, F.col("s") / (F.col("n") + 1e-8))) / seqs * dp_size
    else:
        value = F.sum("s") / (F.lit(factor) if factor else F.max("width"))
    return rows.agg(value.alias("loss"), *[(F.sum(f"x_{k}") / (F.sum("n") + 1e-8)).alias(k) for k in extra])


def _weighted(tok: DataFrame, loss: Column) -> Column:
    return loss * F.col("rho") if "rho" in tok.columns else loss


@register("vanilla")
def vanilla(tok: DataFrame, mode: str = "token-mean", low: float = 0.2, high: float = 0.2, c: float = 3.0) -> DataFrame:
    d, a = clamp(F.col("logp") - F.col("old"), -20.0, 20.0), F.col("adv")
    ratio = F.exp(d)
    l1, l2 = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high)
    c1, l3 = F.greatest(l1, l2), -a * c
    loss = F.when(a < 0, F.least(l3, c1)).otherwise(c1)
    return agg_loss(tok, _weighted(tok, loss), mode, {"clipfrac": (l2 > l1).cast("double"), "ppo_kl": -d, "clipfrac_lower": ((c1 > l3) & (a < 0)).cast("double")})


def _row_mean(x: Column) -> Column:
    w = Window.partitionBy("row_id")
    return F.sum(used(x)).over(w) / F.greatest(F.sum("m").over(w), F.lit(1))


@register("gspo")
def gspo(tok: DataFrame, mode: str = "seq-mean-token-mean", low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Sequence ratios; always a mean of sequence means."""
    tok = tok.withColumn("_d", _row_mean(F.col("logp") - F.col("old")))
    ratio, a = F.exp(clamp(F.col("_d"), None, 10.0)), F.col("adv")
    l1, l2 = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high)
    return agg_loss(tok, _weighted(tok, F.greatest(l1, l2)), "seq-mean-token-mean", {"clipfrac": (l2 > l1).cast("double"), "ppo_kl": -F.col("_d")})


@register("sapo")
def sapo(tok: DataFrame, mode: str = "seq-mean-token-mean", tau_pos: float = 1.0, tau_neg: float = 1.05) -> DataFrame:
    d, a = clamp(F.col("logp") - F.col("old"), -20.0, 20.0), F.col("adv")
    tau = F.when(a > 0, tau_pos).otherwise(tau_neg)
    gate = 1 / (1 + F.exp(-tau * (F.exp(d) - 1))) * 4 / tau
    return agg_loss(tok, _weighted(tok, -gate * a), mode, {"ppo_kl": -d})


@register("gpg")
def gpg(tok: DataFrame, mode: str = "token-mean") -> DataFrame:
    return agg_loss(tok, _weighted(tok, -F.col("logp") * F.col("adv")), mode)


@register("cispo")
def cispo(tok: DataFrame, mode: str = "token-mean", low: float = 0.2, high: float = 0.2) -> DataFrame:
    d = clamp(F.col("logp") - F.col("old"), -20.0, 20.0)
    ratio = F.exp(d)
    cut = clamp(ratio, 1 - low, 1 + high)
    return agg_loss(tok, _weighted(tok, -cut * F.col("adv") * F.col("logp")), mode, {"clipfrac": (ratio != cut).cast("double"), "ppo_kl": -d})


@register("geo_mean")
def geo_mean(tok: DataFrame, mode: str = "token-mean", low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Clipped log ratios averaged over a sequence; a plain mean over sequences."""
    d, a = clamp(F.col("logp") - F.col("old"), -20.0, 20.0), F.col("adv")
    sign = F.when(a > 0, 1.0).when(a < 0, -1.0).otherwise(0.0)
    low_d = sign * F.least(sign * d, sign * clamp(d, -low, high))
    rows = tok.groupBy("row_id").agg(F.sum("m").alias("n"), F.sum(used(low_d)).alias("d"), F.sum(used(a)).alias("a"), F.sum(used((low_d != d).cast("double"))).alias("c"), F.sum(used(-d)).alias("k"))
    n = F.col("n") + 1e-8
    return rows.agg(F.avg(-F.exp(F.col("d") / n) * F.col("a") / n).alias("loss"), (F.sum("c") / (F.sum("n") + 1e-8)).alias("clipfrac"), (F.sum("k") / (F.sum("n") + 1e-8)).alias("ppo_kl"))


def _covariance(tok: DataFrame) -> DataFrame:
    """Adds cov, the product of deviations from the means over unmasked tokens."""
    means = tok.agg((F.sum(used(F.col("adv"))) / (F.sum("m") + 1e-8)).alias("_a"), (F.sum(used(F.col("logp"))) / (F.sum("m") + 1e-8)).alias("_l"))
    return tok.crossJoin(F.broadcast(means)).withColumn("cov", (F.col("adv") - F.col("_a")) * (F.col("logp") - F.col("_l"))).drop("_a", "_l")


@register("kl_cov")
def kl_cov(tok: DataFrame, mode: str = "token-mean", ratio: float = 0.0002, coef: float = 1.0, order: tuple[str, ...] = ("row_id", "pos")) -> DataFrame:
    """The tokens of highest covariance (max(1, int(n * ratio)) of all unmasked ones, ties by `order`) pay for their KL. A top-k: no global sort."""
    tok = _covariance(tok)
    k = max(1, int(tok.where("m <> 0").count() * ratio))
    top = tok.where("m <> 0").orderBy(F.desc("cov"), *order).limit(k).select(*order).withColumn("_top", F.lit(True))
    tok = tok.join(top, list(order), "left")
    d, a = F.col("logp") - F.col("old"), F.col("adv")
    loss = -a * F.exp(d) + F.when(F.col("_top"), coef * F.abs(d)).otherwise(0.0)
    return agg_loss(tok, _weighted(tok, loss), mode, {"ppo_kl": F.abs(d)})


@register("clip_cov")
def clip_cov(tok: DataFrame, mode: str = "token-mean", ratio: float = 0.0002, low: float = 1.0, high: float = 5.0, clip_low: float = 0.2, clip_high: float = 0.2, seed: int = 0, order: tuple[str, ...] = ("row_id", "pos")) -> DataFrame:
    """A random few (by seeded hash) of the tokens whose covariance lies between the bounds are left out."""
    tok = _covariance(tok)
    d, a = clamp(F.col("logp") - F.col("old"), -20.0, 20.0), F.col("adv")
    ratio_c = F.exp(d)
    l1, l2 = -a * ratio_c, -a * clamp(ratio_c, 1 - clip_low, 1 + clip_high)
    k = max(1, int(tok.where("m <> 0").count() * ratio))
    open_ = tok.where((F.col("m") != 0) & (F.col("cov") > low) & (F.col("cov") < high) & ~(l2 > l1))
    out = open_.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(k).select(*order).withColumn("_out", F.lit(True))
    tok = tok.join(out, list(order), "left")
    loss = F.when(F.col("_out"), 0.0).otherwise(F.greatest(l1, l2))
    return agg_loss(tok, _weighted(tok, loss), mode, {"clipfrac": F.coalesce(F.col("_out"), F.lit(False)).cast("double"), "ppo_kl": -d})


@register("bypass_mode")
def bypass(tok: DataFrame, mode: str = "token-mean", inner: str = "reinforce") -> DataFrame:
    """Losses against the rollout's own probabilities, tokens weighted and rejected beforehand (rho, m)."""
    return reinforce(tok, mode) if inner == "reinforce" else vanilla(tok, mode)


def reinforce(tok: DataFrame, mode: str = "seq-mean-token-sum") -> DataFrame:
    return agg_loss(tok, _weighted(tok, -F.col("adv") * F.col("logp")), mode, {"kl": F.col("old") - F.col("logp")})


def value_loss(tok: DataFrame, mode: str = "token-mean", cliprange: float = 0.5) -> DataFrame:
    cut = F.greatest(F.least(F.col("vpred"), F.col("v") + cliprange), F.col("v") - cliprange)
    one, two = (F.col("vpred") - F.col("ret")) ** 2, (cut - F.col("ret")) ** 2
    out = agg_loss(tok, F.greatest(one, two), mode, {"clipfrac": (two > one).cast("double")})
    return out.withColumn("loss", 0.5 * F.col("loss"))


def entropy_loss(tok: DataFrame, mode: str = "token-mean") -> DataFrame:
    return agg_loss(tok, F.col("entropy"), mode)


def composite(tok: DataFrame, policy: str = "vanilla", mode: str = "token-mean", entropy_coef: float = 0.0, kl: Column | None = None, kl_coef: float = 0.0) -> DataFrame:
    """Policy loss - entropy_coef * entropy + kl_coef * kl."""
    out = get(policy)(tok, mode).withColumnRenamed("loss", "pg_loss")
    total = F.col("pg_loss")
    if entropy_coef:
        out = out.crossJoin(entropy_loss(tok, mode).withColumnRenamed("loss", "entropy_loss"))
        total = total - entropy_coef * F.col("entropy_loss")
    if kl is not None:
        out = out.crossJoin(agg_loss(tok, kl, mode).withColumnRenamed("loss", "kl_loss"))
        total = total + kl_coef * F.col("kl_loss")
    return out.withColumn("loss", total)


def supervised(tok: DataFrame, tokens: float | None = None, dp_size: int = 1) -> DataFrame:
    """One row: the negative log-probability of tokens whose following token is trained (mask m shifted by one within its row), over all trained tokens."""
    from pyspark.sql import Window

    after = F.coalesce(F.lead("m").over(Window.partitionBy("row_id").orderBy("pos")), F.lit(0))
    shifted = tok.withColumn("after", after)
    n = F.lit(float(tokens)) if tokens else F.sum("m")
    return shifted.agg((-F.sum(F.when(F.col("after") != 0, F.col("logp"))) / n * dp_size).alias("loss"))


def clipped_ratio(tok: DataFrame, mode: str = "token-mean", clip: float = 0.2, c: float = 3.0) -> DataFrame:
    """The former form of the policy loss: one clip range for both sides, loss, shares of clipped tokens and the mean log-ratio, without weights."""
    return vanilla(tok.drop("rho"), mode, clip, clip, c)
