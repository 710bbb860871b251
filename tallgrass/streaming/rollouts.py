"""Rollout streams: bounded queues that drop the oldest, count windows, staleness budgets, partial rollouts. Each has a form over a table and, where state is kept, one over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_newest(df: DataFrame, capacity: int, queue: str, *order: str) -> DataFrame:
    """What a queue holds in the end: its `capacity` newest rows."""
    w = Window.partitionBy(queue).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")


def queue_statistics(df: DataFrame, capacity: int, queue: str) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(queue).agg(n.alias("produced"), F.least(n, F.lit(capacity)).alias("size"), F.greatest(n - capacity, F.lit(0)).alias("dropped"))


def count_windows(df: DataFrame, size: int, queue: str, *order: str) -> DataFrame:
    """Adds batch_no; rows of an incomplete last batch are left out."""
    w = Window.partitionBy(queue)
    rank = F.row_number().over(w.orderBy(*order)) - 1
    full = F.floor(F.count(F.lit(1)).over(w) / size) * size
    return df.withColumn("_r", rank).withColumn("_full", full).where("_r < _full").withColumn("batch_no", F.floor(F.col("_r") / size).cast("long")).drop("_r", "_full")


def staleness_budget(required: int, threshold: float, sync_steps: int) -> float:
    return required * (threshold + 1) * sync_steps


def paused(queue_size: Column, capacity: int, stale: Column, budget: float) -> Column:
    return (queue_size >= capacity) | (stale >= budget)


def stale_counts(df: DataFrame, current: str, row_version: str) -> DataFrame:
    """How many rows of each current version were made under an older one, and the total so far."""
    per = df.groupBy(current).agg(F.sum((F.col(current) - F.col(row_version) >= 1).cast("long")).alias("stale"))
    return per.withColumn("stale_total", F.sum("stale").over(Window.partitionBy(F.lit(0)).orderBy(current)))


def ring(df: DataFrame, capacity: int, seq: str) -> DataFrame:
    """A ring buffer's slots: the latest row of each."""
    cols = [c for c in df.columns if c != seq]
    return df.groupBy((F.col(seq) % capacity).alias("slot")).agg(F.max_by(F.struct(seq, *cols), seq).alias("x")).select("slot", "x.*")


def assemble_partial(parts: DataFrame) -> DataFrame:
    """Partial rollouts (sample_id, part_no, tokens, version, finished) as whole ones: tokens in order, first and last version, span; only those whose last part finished."""
    packed = parts.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("part_no", "tokens", "version", "finished"))).alias("p"))
    out = packed.select("sample_id", F.flatten("p.tokens").alias("tokens"), F.array_min("p.version").alias("version_start"), F.array_max("p.version").alias("version_end"), F.element_at("p.finished", -1).alias("finished"), F.size("p").alias("n_parts"))
    return out.where("finished").drop("finished").withColumn("version_span", F.col("version_end") - F.col("version_start"))


def drop_oldest_stream(stream: DataFrame, capacity: int, key: str = "queue") -> DataFrame:
    """Over a stream (queue, item): after every batch the queue's items, oldest first, and how many were dropped so far. State is one list of at most `capacity` items for each queue."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        items, dropped = state.get if state.exists else ([], 0)
        items = list(items)
        for b in batches:
            items += b["item"].astype(int).tolist()
        extra = max(0, len(items) - capacity)
        items, dropped = items[extra:], dropped + extra
        state.update((items, dropped))
        yield pd.DataFrame({key: [k[0]], "items": [items], "dropped": [dropped]})

    return stream.select(key, F.col("item").cast("long").alias("item")).groupBy(key).applyInPandasWithState(step, f"{key} string, items array<long>, dropped long", "items array<long>, dropped long", "update", "NoTimeout")


def windowed_counts(stream: DataFrame, ts: str, width: str, slide: str | None, delay: str, *keys: str) -> DataFrame:
    """Counts by event-time window with a watermark."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, ts: str, gap: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def feed(prompts: DataFrame, n: int, epochs: int, row: str = "row_id") -> DataFrame:
    """A prompt for each epoch as n samples: sample_id sample_{epoch}_{step}, where step goes on over epochs, and the number among its n."""
    size = prompts.count()
    out = prompts.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    out = out.withColumn("step", F.col("epoch") * F.lit(size) + F.col(row) + 1)
    out = out.withColumn("sample_id", F.concat_ws("_", F.lit("sample"), F.col("epoch").cast("string"), F.col("step").cast("string")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def version_bumps(events: DataFrame) -> DataFrame:
    """(version, active, cancelled, queued, started, idle_since, at) -> version, staleness, which begins again with what is under way, and the share of idle time (null where nothing idled)."""
    idle = F.when(F.col("idle_since").isNotNull() & F.col("started").isNotNull(), 1 - (F.col("idle_since") - F.col("started")) / (F.col("at") - F.col("started")))
    return events.select("version", (F.col("active") + F.col("cancelled") + F.col("queued")).alias("staleness"), idle.alias("idle_ratio"))


def syncs(steps: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Steps after which parameters are sent, with the version that they get."""
    return steps.where(F.col(step) % every == 0).withColumn("version", (F.col(step) / every).cast("long"))


def requeued(parts: DataFrame) -> DataFrame:
    """Partial rollouts whose last part didn't finish, as they go back into the queue: tokens so far, and the versions that made them."""
    packed = parts.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("part_no", "tokens", "version", "finished"))).alias("p"))
    out = packed.select("sample_id", F.flatten("p.tokens").alias("tokens"), F.array_min("p.version").alias("version_start"), F.array_max("p.version").alias("version_end"), F.element_at("p.finished", -1).alias("finished"))
    return out.where("NOT finished").drop("finished")


def replay_sample(slots: DataFrame, n: int, seed: int = 0, slot: str = "slot") -> DataFrame:
    """n slots without replacement, by a hash of slot and seed. n is the feature: a batch."""
    return slots.orderBy(F.crc32(F.concat(F.lit(f"{seed}:"), F.col(slot).cast("string")).cast("binary")), slot).limit(n)


def resized(slots: DataFrame, capacity: int, new: int, slot: str = "slot") -> DataFrame:
    """The buffer with another capacity: slots beyond it go, new ones are empty."""
    kept = slots.where(F.col(slot) < new)
    if new <= capacity:
        return kept
    return kept.unionByName(slots.sparkSession.range(capacity, new).select(F.col("id").cast(slots.schema[slot].dataType).alias(slot)), allowMissingColumns=True)
