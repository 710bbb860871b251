"""Metrics of batches and of validation runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_name_rule(name: Column, value: Column) -> Column:
    """max where the name has "max" in it, else min where it has "min", else the mean."""
    return F.when(F.max(name).contains("max"), F.max(value)).when(F.max(name).contains("min"), F.min(value)).otherwise(F.avg(value))


def reduce_metrics(long: DataFrame) -> DataFrame:
    """(name, value) -> one value for each name."""
    return long.groupBy("name").agg(by_name_rule(F.col("name"), F.col("value")).alias("value"))


def merge_ranks(long: DataFrame) -> DataFrame:
    """(step, rank, name, agg, value): sums and means average over ranks at each step first, then aggregate over steps; extremes run over everything."""
    per = long.groupBy("name", "agg", "step").agg(F.avg("value").alias("mean"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    out = F.when(F.col("agg") == "sum", F.sum("mean")).when(F.col("agg") == "max", F.max("hi")).when(F.col("agg") == "min", F.min("lo")).otherwise(F.avg("mean"))
    return per.groupBy("name", "agg").agg(out.alias("value"))


#: How asynchronous metrics are combined, first match counts.
ASYNC_RULES = (("last", "global_steps|current_param_version"), ("time_sum", "timing_s/"), ("avg", "avg|mean|ratio"), ("max", "max"), ("min", "min"), ("sum", "count|total|sum"))


def async_rule(name: Column) -> Column:
    rule = F.lit("avg")
    for kind, pattern in reversed(ASYNC_RULES):
        rule = F.when(name.rlike(pattern), kind).otherwise(rule)
    return rule


def aggregate_async(long: DataFrame) -> DataFrame:
    """(step, name, value) by the rules."""
    r = async_rule(F.col("name"))
    out = F.when(F.col("rule") == "last", F.max_by("value", "step")).when(F.col("rule").isin("sum", "time_sum"), F.sum("value")).when(F.col("rule") == "max", F.max("value")).when(F.col("rule") == "min", F.min("value")).otherwise(F.avg("value"))
    return long.withColumn("rule", r).groupBy("name", "rule").agg(out.alias("value"))


def sequence_metrics(rows: DataFrame, max_response: int) -> DataFrame:
    """One row about rollouts (score, reward, prompt_length, response_length): means and extremes, clip and abort ratios; aborted rollouts (length 0) count only in their ratio and the plain lengths."""
    alive = F.col("response_length") > 0
    three = lambda c, p, cond=None: [f(F.when(alive, F.col(c)) if cond else F.col(c)).alias(f"{p}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return rows.agg(*three("score", "score", True), *three("reward", "reward", True), *three("prompt_length", "prompt_length"), *three("response_length", "response_length"), F.avg((F.col("response_length") == max_response).cast("double")).alias("clip_ratio"), F.avg((~alive).cast("double")).alias("aborted_ratio"))


def explained_variance(tok: DataFrame, returns: str = "ret", values: str = "v") -> Column:
    d = F.var_samp(F.when(F.col("m") != 0, F.col(returns) - F.col(values)))
    return 1 - d / (F.var_samp(F.when(F.col("m") != 0, F.col(returns))) + 1e-5)


def majority(rows: DataFrame, group: list[str], vote: str, value: str, pos: str) -> DataFrame:
    """Value of the first row that cast each group's commonest vote; among equally common ones the first seen wins."""
    votes = rows.groupBy(*group, vote).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(pos, value)).alias("first"))
    best = votes.groupBy(*group).agg(F.max_by(F.struct("first", vote), F.struct("n", (-F.col(f"first.{pos}")).alias("p"))).alias("b"))
    return best.select(*group, F.col(f"b.{vote}").alias(vote), F.col(f"b.first.{value}").alias(value))


def sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, and n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n]


def bootstrap_indices(n: int, k: int, times: int = 1000, seed: int = 42) -> np.ndarray:
    """times x k draws with replacement from range(n), by the legacy generator."""
    return np.random.RandomState(seed).choice(n, size=(times, k), replace=True)


def best_worst(rows: DataFrame, group: list[str], value: str, pos: str, times: int = 1000, seed: int = 42) -> DataFrame:
    """(group, k, best_mean, best_std, worst_mean, worst_std) by bootstrap. Draws depend on a group's size only, so one index table for each size is made here and sent to every task: times x k numbers for each, none of them data. A group's draws are folded in its row, one row for each k."""
    spark = rows.sparkSession
    packed = rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("x")).withColumn("n", F.size("x"))
    counts = [r.n for r in packed.select("n").distinct().where("n > 1").collect()]
    table = [(n, k, bootstrap_indices(n, k, times, seed).tolist()) for n in counts for k in sizes(n)]
    draws = F.broadcast(spark.createDataFrame(table, "n int, k int, idx array<array<int>>"))
    drawn = lambda pick: F.filter(F.transform("idx", lambda row: pick(F.transform(row, lambda i: F.get("x", i)))), lambda y: y.isNotNull())
    mean = lambda y: F.try_divide(F.aggregate(y, F.lit(0.0), lambda s, e: s + e), F.size(y))
    spread = lambda y, m: F.sqrt(F.try_divide(F.aggregate(y, F.lit(0.0), lambda s, e: s + (e - m) * (e - m)), F.size(y)))
    picked = packed.join(draws, "n").select(*group, "k", drawn(F.array_max).alias("best"), drawn(F.array_min).alias("worst"))
    means = picked.select("*", mean(F.col("best")).alias("best_mean"), mean(F.col("worst")).alias("worst_mean"))
    return means.select(*group, "k", "best_mean", spread(F.col("best"), F.col("best_mean")).alias("best_std"), "worst_mean", spread(F.col("worst"), F.col("worst_mean")).alias("worst_std"))


def validation_means(rows: DataFrame) -> DataFrame:
    """(data_source, uid, score) -> mean over prompts of each prompt's mean and population deviation."""
    per = rows.groupBy("data_source", "uid").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("data_source").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.max("n").alias("n_max"))


def metric_section(variable: Column, metric: Column, n_max: Column, core: str = "acc") -> Column:
    """val-core for the core variable's mean, majority and best at the largest n, val-aux for the rest."""
    top = metric.rlike("^(mean|maj|best)@") & metric.endswith(F.concat(F.lit("@"), n_max.cast("string"), F.lit("/mean")))
    return F.when((variable == core) & (top | (metric == F.concat(F.lit("mean@"), n_max.cast("string")))), "val-core").otherwise("val-aux")


def islands(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds traj_ordinal: the number of a row in its run of equal consecutive keys."""
    w = Window.partitionBy(*order[:-1]).orderBy(order[-1])
    df = df.withColumn("_new", F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w))
    return df.withColumn("traj_ordinal", F.row_number().over(Window.partitionBy(*order[:-1], "_run").orderBy(order[-1])) - 1).drop("_new", "_run")


def batch_metrics(rows: DataFrame, tok: DataFrame, max_response: int, max_prompt: int) -> DataFrame:
    """One row of all metrics of a batch: rows (score, reward, prompt_length, response_length, num_turns, tool_calls), one for each rollout, and tokens (m, adv, ret, v). Aborted rollouts (length 0) count only in their ratio and in the plain lengths; a batch of nothing else is an error."""
    alive = F.col("response_length") > 0
    three = lambda c, p: [f(c).alias(f"{p}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    lengths = [*three(F.col("response_length"), "response_length"), F.avg((F.col("response_length") == max_response).cast("double")).alias("response_length_clip_ratio")]
    living = F.when(alive, F.col("response_length"))
    lengths += [*three(living, "response_length_non_aborted"), F.avg((living == max_response).cast("double")).alias("response_length_non_aborted_clip_ratio")]
    lengths += [*three(F.col("prompt_length"), "prompt_length"), F.avg((F.col("prompt_length") == max_prompt).cast("double")).alias("prompt_length_clip_ratio")]
    per_row = rows.agg(
        *three(F.when(alive, F.col("score")), "score"),
        *three(F.when(alive, F.col("reward")), "rewards"),
        *lengths,
        F.avg((~alive).cast("double")).alias("aborted_ratio"),
        *three(F.col("num_turns"), "num_turns"),
        *three(F.col("tool_calls"), "tool_call_counts"),
        F.assert_true(F.count_if(alive) > 0, "all rollouts are aborted").alias("_alive"),
    ).drop("_alive")
    kept = tok.where("m <> 0")
    d, r = F.var_samp(F.col("ret") - F.col("v")), F.var_samp("ret")
    per_token = kept.agg(*three(F.col("adv"), "advantages"), *three(F.col("ret"), "returns"), *three(F.col("v"), "values"), (1 - d / (r + 1e-5)).alias("vf_explained_var"))
    # one row beside one row
    return per_row.withColumn("_one", F.lit(1)).join(per_token.withColumn("_one", F.lit(1)), "_one").drop("_one")


def timing_metrics(rows: DataFrame, timings: dict[str, float]) -> DataFrame:
    """(name, value): seconds of each section, and milliseconds a token: of responses for gen, of all tokens for the sections that read both."""
    tokens = rows.agg(F.sum("prompt_length").alias("p"), F.sum("response_length").alias("r"))
    whole = ("ref", "values", "adv", "update_critic", "update_actor")
    out = [F.struct(F.lit(f"timing_s/{k}").alias("name"), F.lit(float(v)).alias("value")) for k, v in timings.items()]
    for k, v in timings.items():
        if k == "gen" or k in whole:
            n = F.col("r") if k == "gen" else F.col("p") + F.col("r")
            out.append(F.struct(F.lit(f"timing_per_token_ms/{k}").alias("name"), (F.lit(float(v)) * 1000 / n).alias("value")))
    return tokens.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def throughput(rows: DataFrame, seconds: float, devices: int) -> DataFrame:
    """Tokens of a step, its time, and tokens a second and device."""
    n = F.sum(F.col("prompt_length") + F.col("response_length"))
    return rows.agg(n.alias("total_num_tokens"), F.lit(float(seconds)).alias("time_per_step"), (n / (seconds * devices)).alias("throughput"))


def variance_proxies(tok: DataFrame, gradient_norm: float | None = None, weights: str | None = None) -> DataFrame:
    """Signal, power and noise of a policy gradient from tokens (row_id, m, old, pi2, adv and, if named, importance weights)."""
    w = 1 - 2 * F.exp("old") + F.col("pi2")
    n = F.sum("m") + 1e-8
    part = lambda x: F.sum(F.when(F.col("m") != 0, x * F.col("m")).otherwise(0.0))
    iw = F.col(weights) if weights else F.lit(1.0)
    rows = tok.groupBy("row_id").agg((part(F.col("adv")) / n).alias("a"), part(w * iw * iw).alias("w"), part(w).alias("w0"), (part(iw) / n).alias("iw"))
    power = F.avg(F.col("iw") * F.col("iw") * F.col("a") * F.col("a") * F.greatest("w0", F.lit(0.0))) if weights else F.avg(F.col("a") * F.col("a") * F.greatest("w", F.lit(0.0)))
    signal = F.lit(float(gradient_norm) ** 2 if gradient_norm is not None else 0.0)
    noise = F.when(F.count(F.lit(1)) > 1, F.greatest((power - signal) / (F.count(F.lit(1)) - 1), F.lit(0.0))).otherwise(0.0) if gradient_norm is not None else F.lit(0.0)
    return rows.agg(signal.alias("signal_strength"), power.alias("total_power"), noise.alias("pure_noise"), F.avg(F.col("a") * F.col("a")).alias("expected_a_squared"), F.avg("w").alias("expected_w"))


def spread(df: DataFrame, value: str) -> DataFrame:
    """Mean, max, min and sample deviation over all partitions."""
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def with_prefix(long: DataFrame, prefix: str) -> DataFrame:
    return long.withColumn("name", F.concat(F.lit(prefix), F.col("name")))


def agent_timing(rows: DataFrame) -> DataFrame:
    """One row about rollouts (row_id, generate_sequences, tool_calls, num_preempted, prompt_length, response_length): extremes and means, and the slowest one (the first of equals)."""
    names = ("num_preempted", "generate_sequences", "tool_calls")
    three = [f(c).alias(f"{c}_{n}") for c in names for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    slowest = F.max_by(F.struct(*names, "prompt_length", "response_length"), F.struct((F.col("generate_sequences") + F.col("tool_calls")).alias("t"), (-F.col("row_id")).alias("first"))).alias("slowest")
    out = rows.agg(*three, slowest)
    return out.select(*[c for c in out.columns if c != "slowest"], *[F.col(f"slowest.{c}").alias(f"slowest_{c}") for c in (*names, "prompt_length", "response_length")])


def derived_async(wide: DataFrame, devices: int) -> DataFrame:
    """What follows from aggregated metrics of a step: the spread of lengths, throughput, and the share of idle time."""
    rules = {
        "global_seqlen/minmax_diff": (("global_seqlen/max", "global_seqlen/min"), lambda a, b: a - b),
        "perf/throughput": (("perf/total_num_tokens", "perf/time_per_step"), lambda a, b: a / (b * devices)),
        "trainer/idle_ratio": (("timing_s/gen", "timing_s/step"), lambda a, b: a / b),
    }
    for name, (needs, rule) in rules.items():
        if set(needs) <= set(wide.columns):
            wide = wide.withColumn(name, rule(*[F.col(f"`{c}`") for c in needs]))
    return wide


def validation_metrics(rows: DataFrame, pred: bool = False) -> DataFrame:
    """(data_source, uid, pos, variable, value and, if so, pred) -> (data_source, variable, metric, value): mean@n, std@n and maj@n of each prompt's n values, averaged over prompts with n values."""
    per = rows.groupBy("data_source", "uid", "variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))
    kinds = {"mean": F.col("mean"), "std": F.when(F.col("n") > 1, F.col("std"))}
    if pred:
        votes = majority(rows, ["data_source", "uid", "variable"], "pred", "value", "pos").select("data_source", "uid", "variable", F.col("value").alias("maj"))
        per = per.join(votes, ["data_source", "uid", "variable"])
        kinds["maj"] = F.when(F.col("n") > 1, F.col("maj"))
    long = per.select("data_source", "variable", "n", F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds.values()))).alias("kind", "value")).where("value IS NOT NULL")
    return long.groupBy("data_source", "variable", F.concat("kind", F.lit("@"), F.col("n").cast("string")).alias("metric")).agg(F.avg("value").alias("value"))


def merge_validation(a: DataFrame, b: DataFrame, pred: bool = False) -> DataFrame:
    """The metrics of two result sets together: their rows are put together first, those of b behind those of a."""
    both = a.withColumn("pos", F.struct(F.lit(0).alias("set"), F.col("pos").alias("at"))).unionByName(b.withColumn("pos", F.struct(F.lit(1).alias("set"), F.col("pos").alias("at"))))
    if not pred:
        return validation_metrics(both)
    w = Window.partitionBy("data_source", "uid", "variable").orderBy("pos")
    return validation_metrics(both.withColumn("pos", F.row_number().over(w)), True)
