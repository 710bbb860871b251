"""Rollout correction: importance weights, rejection masks and off-policy diagnostics on a flat token view (row_id, pos, m, old, roll)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.losses import clamp, used

OPTIONS = ("token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3")


def _row():
    return Window.partitionBy("row_id")


def parse_thresholds(options: list[str], spec: str | float | None) -> dict[str, tuple[float, float]]:
    """Bounds (low, high) by option from "lo_hi" or one number (k1: its inverse below), comma-separated or shared."""
    if spec is None:
        raise ValueError("rejection needs thresholds")
    parts = [p.strip() for p in str(spec).split(",")]
    parts = parts * len(options) if len(parts) == 1 else parts
    if len(parts) != len(options):
        raise ValueError("as many thresholds as options are needed, or one")
    out = {}
    for name, p in zip(options, parts, strict=True):
        if name not in OPTIONS:
            raise ValueError(f"unknown rejection option {name}")
        lo, hi = (map(float, p.split("_")) if "_" in p else (1 / float(p) if name.endswith("k1") else 0.0, float(p)))
        if hi <= 0 or lo < 0 or lo > hi:
            raise ValueError(f"bad threshold {p}")
        out[name] = (lo, hi)
    return out


def log_ratio() -> Column:
    return F.col("old") - F.col("roll")


def importance_weights(tok: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False) -> DataFrame:
    """Adds rho: exp of the log ratio (of the token, or summed over the sequence), cut at the threshold, 0 where masked; optionally scaled to a batch mean of 1."""
    x = log_ratio() if level == "token" else F.sum(used(log_ratio())).over(_row())
    if level not in ("token", "sequence"):
        raise ValueError(f"unknown importance level {level}")
    w = F.least(F.exp(clamp(x, -20.0, 20.0)) * F.col("m"), F.lit(threshold))
    out = tok.withColumn("rho", w)
    if normalize:
        mean = out.agg((F.sum(used(F.col("rho"))) / F.sum("m")).alias("_mean")) if level == "token" else out.where("m <> 0").groupBy("row_id").agg(F.max("rho").alias("r")).agg(F.avg("r").alias("_mean"))
        out = out.crossJoin(F.broadcast(mean)).withColumn("rho", F.col("rho") / F.greatest(F.col("_mean"), F.lit(1e-8))).drop("_mean")
    return out


def _divergence(kind: str, x: Column) -> Column:
    x = clamp(x, -20.0, 20.0)
    return {"k1": -x, "k2": 0.5 * x * x, "k3": F.exp(x) - 1 - x}[kind]


def statistic(option: str) -> Column:
    """What an option compares with its bounds, for each token."""
    level, kind = option.rsplit("_", 1)
    each = _divergence(kind, log_ratio())
    if level == "token":
        return each
    total, n = F.sum(used(each)).over(_row()), F.sum("m").over(_row())
    if level == "seq_sum":
        return total
    if level == "seq_mean":
        return total / (n + 1e-8)
    return F.max(F.when(F.col("m") != 0, each)).over(_row())


def reject(tok: DataFrame, options: str, thresholds: str | float) -> DataFrame:
    """Adds keep: the mask times the conditions of all options (named once or more, separated by commas)."""
    import math

    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    bounds = parse_thresholds(names, thresholds)
    keep = F.col("m")
    for name in names:
        lo, hi = bounds[name]
        s = statistic(name)
        ok = s.between(math.log(lo), math.log(hi)) if name.endswith("k1") else s <= hi
        keep = F.when(F.coalesce(ok, F.lit(True)), keep).otherwise(0)
    return tok.withColumn("keep", keep)


def offpolicy_metrics(tok: DataFrame) -> DataFrame:
    """One row: perplexities, their log differences, KL by k1 and k3, chi-square by token and by sequence."""
    n = F.sum("m") + 1e-8
    x = clamp(log_ratio(), -20.0, 20.0)
    rows = tok.groupBy("row_id").agg((F.sum(used(F.col("old"))) / n).alias("t"), (F.sum(used(F.col("roll"))) / n).alias("r"), F.sum("m").alias("n"), F.sum(used(log_ratio())).alias("s"), F.sum(used(F.col("roll") - F.col("old"))).alias("k1"), F.sum(used(F.exp(log_ratio()) - log_ratio() - 1)).alias("k3"), F.sum(used(F.exp(2 * x))).alias("c"))
    tokens = F.sum("n") + 1e-8
    d = F.col("r") - F.col("t")
    return rows.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"), F.avg(-F.col("t")).alias("training_log_ppl"), F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(d).alias("log_ppl_diff"), F.avg(F.abs(d)).alias("log_ppl_abs_diff"), F.max(d).alias("log_ppl_diff_max"), F.min(d).alias("log_ppl_diff_min"), F.avg(F.exp(d)).alias("ppl_ratio"),
        (F.sum("k1") / tokens).alias("kl"), (F.sum("k3") / tokens).alias("k3_kl"), (F.sum("c") / tokens - 1).alias("chi2_token"), (F.avg(F.exp(2 * clamp(F.col("s"), -20.0, 20.0))) - 1).alias("chi2_seq"),
    )


def is_metrics(tok: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row about untruncated token weights: mean, max, min, share above and below the bounds, std and effective sample size of weights held between them."""
    w = F.exp(clamp(log_ratio(), -20.0, 20.0))
    held = F.greatest(F.least(w, F.lit(threshold)), F.lit(1 / threshold))
    t = tok.where("m <> 0").select(w.alias("w"), held.alias("h"))
    mean = F.avg("h")
    return t.agg(F.avg("w").alias("is_mean"), F.max("w").alias("is_max"), F.min("w").alias("is_min"), F.avg((F.col("w") > threshold).cast("double")).alias("is_high"), F.avg((F.col("w") < 1 / threshold).cast("double")).alias("is_low"), F.sqrt(F.greatest(F.avg(F.col("h") * F.col("h")) - mean * mean, F.lit(0.0))).alias("is_std"), (mean * mean / F.avg(F.col("h") * F.col("h"))).alias("is_ess"))


def probability_difference(tok: DataFrame) -> DataFrame:
    """One row: max, mean and std of the difference of probabilities, and their correlation."""
    t = tok.where("m <> 0").select(F.exp("roll").alias("a"), F.exp("old").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return t.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.corr("a", "b").alias("pearson"))


@dataclass(frozen=True)
class Preset:
    """A named combination of weights and rejections; bypass: the rollout's probabilities stand for the old ones."""

    weights: str | None = None
    weight_threshold: float = 2.0
    reject: str | None = None
    reject_threshold: str | float | None = None
    bypass: bool = False
    loss: str = "ppo_clip"


PRESETS = {
    "decoupled_token_is": Preset("token"),
    "decoupled_seq_is": Preset("sequence"),
    "decoupled_seq_is_rs": Preset("sequence", reject="seq_sum_k1", reject_threshold="0.5_2.0"),
    "decoupled_geo_rs": Preset(reject="seq_mean_k1", reject_threshold="0.999_1.001"),
    "decoupled_geo_rs_seq_tis": Preset("sequence", reject="seq_mean_k1", reject_threshold="0.999_1.001"),
    "decoupled_geo_rs_token_tis": Preset("token", reject="seq_mean_k1", reject_threshold="0.999_1.001"),
    "decoupled_k3_rs": Preset(reject="seq_mean_k3", reject_threshold=0.01),
    "decoupled_k3_rs_seq_tis": Preset("sequence", reject="seq_mean_k3", reject_threshold=0.01),
    "decoupled_k3_rs_token_tis": Preset("token", reject="seq_mean_k3", reject_threshold=0.01),
    "bypass_ppo_clip": Preset(bypass=True),
    "bypass_ppo_clip_geo_rs": Preset(reject="seq_mean_k1", reject_threshold="0.999_1.001", bypass=True),
    "bypass_ppo_clip_k3_rs": Preset(reject="seq_mean_k3", reject_threshold=0.01, bypass=True),
    "bypass_pg_is": Preset("sequence", bypass=True, loss="reinforce"),
    "bypass_pg_geo_rs": Preset(reject="seq_mean_k1", reject_threshold="0.999_1.001", bypass=True, loss="reinforce"),
    "bypass_pg_geo_rs_seq_tis": Preset("sequence", reject="seq_mean_k1", reject_threshold="0.999_1.001", bypass=True, loss="reinforce"),
    "bypass_pg_geo_rs_token_tis": Preset("token", reject="seq_mean_k1", reject_threshold="0.999_1.001", bypass=True, loss="reinforce"),
    "disabled": Preset(),
}


def apply_preset(tok: DataFrame, name: str) -> DataFrame:
    """Adds rho (1 without weights) and replaces m by what is kept."""
    p = PRESETS[name]
    out = tok.withColumn("old", F.col("roll")) if p.bypass else tok
    out = importance_weights(out, p.weights, p.weight_threshold) if p.weights else out.withColumn("rho", F.lit(1.0))
    return reject(out, p.reject, p.reject_threshold).withColumn("m", F.col("keep")).drop("keep") if p.reject else out


def option_metrics(tok: DataFrame, name: str, thresholds: str | float) -> DataFrame:
    """One row about an option's statistic over unmasked tokens: mean, extremes, shares beyond the bounds, deviation of values held between them, and the same of sequence means."""
    import math

    lo, hi = parse_thresholds([name], thresholds)[name]
    two = name.endswith("k1")
    if two:
        lo, hi = math.log(lo), math.log(hi)
    s = F.col("s")
    stat = tok.withColumn("s", statistic(name)).where("m <> 0")
    held = F.greatest(F.least(s, F.lit(hi)), F.lit(lo if two else 0.0))
    n = F.count(F.lit(1)) + 1e-8
    high, low = (s > hi).cast("double"), (s < lo).cast("double") if two else F.lit(0.0)
    square = F.sum(held * held) / n - (F.sum(held) / n) * (F.sum(held) / n)
    per = stat.agg((F.sum("s") / n).alias("mean"), F.max("s").alias("max"), F.min("s").alias("min"), (F.sum(high) / n).alias("fraction_high"), (F.sum(low) / n).alias("fraction_low"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("std"))
    seqs = stat.groupBy("row_id").agg((F.sum("s") / (F.count(F.lit(1)) + 1e-8)).alias("s"))
    of_seq = seqs.agg(F.avg("s").alias("seq_mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("seq_std"), F.max("s").alias("seq_max"), F.min("s").alias("seq_min"), F.max(F.abs("s")).alias("seq_max_deviation"), F.avg(high).alias("seq_fraction_high"), F.avg(low).alias("seq_fraction_low"))
    out = per.withColumn("_one", F.lit(1)).join(of_seq.withColumn("_one", F.lit(1)), "_one").drop("_one")
    # a sequence's statistic counts once for each sequence
    return out.withColumns({"fraction_high": F.col("seq_fraction_high"), "fraction_low": F.col("seq_fraction_low")}) if name.startswith("seq_") else out


def mismatches(a, b, mask):
    """How many unmasked tokens of two arrays differ."""
    return F.size(F.filter(F.zip_with(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), mask, lambda d, m: d & (m == 1)), lambda x: x)).cast("long")
