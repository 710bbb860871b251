"""Reward managers over scored rows, and rate limits as folds over requests."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.graders import overlong_penalty

_MANAGERS: dict[str, Callable] = {}


def register(name: str) -> Callable:
    def put(fn: Callable) -> Callable:
        if _MANAGERS.get(name, fn) is not fn:
            raise ValueError(f"reward manager {name} is registered twice")
        _MANAGERS[name] = fn
        return fn

    return put


def manager(name: str) -> Callable:
    if name not in _MANAGERS:
        raise ValueError(f"unknown reward manager {name}: {', '.join(sorted(_MANAGERS))}")
    return _MANAGERS[name]


def placed(score: Column, length: Column, width: Column) -> Column:
    """The score at a row's last valid token. A length of 0 means the last slot, as an index of -1 does."""
    at = F.when(length > 0, length - 1).otherwise(width - 1)
    return F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: F.when(i == at, score.cast("double")).otherwise(F.lit(0.0)))


@register("naive")
def naive(rows: DataFrame, grade: Callable[[], Column], length: str = "length", width: str = "width") -> DataFrame:
    """Adds reward (an array by token) from grade(), a number or a struct with a field score; further fields of the struct become columns."""
    rows = rows.withColumn("_g", grade())
    kind = rows.schema["_g"].dataType
    fields = kind.fieldNames() if hasattr(kind, "fieldNames") else []
    score = F.col("_g.score") if fields else F.col("_g")
    extra = [F.col(f"_g.{f}").alias(f) for f in fields]
    return rows.select("*", *extra, placed(score, F.col(length), F.col(width)).alias("reward")).drop("_g")


@register("batch")
def batch(rows: DataFrame, grade: Callable[[pd.Series, pd.Series], pd.Series], text: str, truth: str, length: str = "length", width: str = "width") -> DataFrame:
    """The same with a grader that takes whole batches."""
    scored = F.pandas_udf(grade, "double")
    return naive(rows, lambda: scored(F.col(text), F.col(truth)), length, width)


@register("dapo")
def dapo(rows: DataFrame, grade: Callable[[], Column], max_length: int, buffer: int, factor: float = 1.0, length: str = "length", width: str = "width") -> DataFrame:
    """naive, with a penalty for responses that reach into the buffer before max_length; adds overlong_reward and overlong."""
    rows = naive(rows, grade, length, width)
    penalty = overlong_penalty(F.col(length), max_length, buffer, factor)
    last = F.when(F.col(length) > 0, F.col(length) - 1).otherwise(F.col(width) - 1)
    return rows.withColumns({"overlong_reward": penalty, "overlong": penalty < 0, "reward": F.transform("reward", lambda x, i: F.when(i == last, x + penalty).otherwise(x))})


@register("precomputed")
def precomputed(rows: DataFrame, grade: Callable[[], Column], scores: str = "rm_scores", length: str = "length", width: str = "width") -> DataFrame:
    """Scores by token that are there already stand; other rows are graded."""
    return naive(rows, grade, length, width).withColumn("reward", F.coalesce(F.col(scores), F.col("reward")))


def extracted(rows: DataFrame, extras: list[str]) -> DataFrame:
    """reward by token and the extra columns alone."""
    return rows.select("row_id", "reward", *extras)


def improved_only(rows: DataFrame, key: str, order: str, reward: str, penalty: float = -0.05) -> Column:
    """A tool's reward for each call: 0 where the answer's reward is above the one of the call before (0 at first), else the penalty."""
    before = F.coalesce(F.lag(reward).over(Window.partitionBy(key).orderBy(order)), F.lit(0.0))
    return F.when(F.col(reward) > before, 0.0).otherwise(penalty)


def token_bucket(requests: DataFrame, key: str, at: str, order: str, tokens: str, rate: float, capacity: float) -> DataFrame:
    """When each request may go: a bucket of `capacity` fills by `rate` a second; a request that finds too little waits until it is there, and one larger than the bucket leaves it negative. One fold for each key, over its requests in order."""
    packed = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, at, tokens))).alias("q"))
    zero = F.struct(F.lit(float(capacity)).alias("have"), F.lit(None).cast("double").alias("t"), F.array().cast(f"array<struct<{order}:bigint,allowed:double>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        now = F.greatest(r[at].cast("double"), F.coalesce(a["t"], r[at].cast("double")))
        have = F.least(F.lit(float(capacity)), a["have"] + F.coalesce(now - a["t"], F.lit(0.0)) * rate)
        need = r[tokens].cast("double")
        wait = F.when(need > capacity, F.greatest((F.lit(float(capacity)) - have) / rate, F.lit(0.0))).otherwise(F.greatest((need - have) / rate, F.lit(0.0)))
        left = F.least(F.lit(float(capacity)), have + wait * rate) - need
        done = F.struct(r[order].cast("bigint").alias(order), (now + wait).alias("allowed"))
        return F.struct(left.alias("have"), (now + wait).alias("t"), F.array_append(a["out"], done).alias("out"))

    return packed.select(key, F.explode(F.aggregate("q", zero, step, lambda a: a["out"])).alias("x")).select(key, f"x.{order}", "x.allowed")
