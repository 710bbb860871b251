"""Partitioning sequences of different lengths over workers. Bounded by one batch: plans are made where a batch's lengths are, in one task for each batch."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame


def workload(length):
    """Cost of a sequence: 24576 L + L * L (numbers, arrays or Columns)."""
    return 24576 * length + length * length


def karmarkar_karp(costs: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: states of k sets are merged, widest spread first, by putting the heaviest of one to the lightest of the other. equal_size deals k at a time, so that all sets get as many."""
    if k < 1 or equal_size and len(costs) % k:
        raise ValueError(f"{len(costs)} items don't make {k} equal sets")
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    if equal_size:
        blocks = [order[i : i + k] for i in range(0, len(order), k)]
    else:
        blocks = [[i] for i in order]
    heap = []
    for number, block in enumerate(blocks):
        sets = sorted(([(costs[i], [i]) for i in block] + [(0, [])] * (k - len(block))), key=lambda s: (s[0], len(s[1]), s[1]))
        heap.append((sets[0][0] - sets[-1][0], number, sets))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sets = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda s: (s[0], len(s[1]), s[1]))
        heapq.heappush(heap, (sets[0][0] - sets[-1][0], number, sets))
        number += 1
    return [sorted(s[1]) for s in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(costs: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each item, in input order, to the set that has least so far (the first of equals); with equal_size to the one with fewest items, of these the one with least."""
    if k < 1 or equal_size and len(costs) % k:
        raise ValueError(f"{len(costs)} items don't make {k} equal sets")
    heap = [(0, 0, s) for s in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, c in enumerate(costs):
        items, total, s = heapq.heappop(heap)
        out[s].append(i)
        heapq.heappush(heap, (items + 1 if equal_size else 0, total + c, s))
    return out


def imbalance(costs: list[int], parts: list[list[int]], prefix: str = "global_seqlen") -> dict[str, float]:
    """Least and most of equal slices of the costs as they come, of the parts, and the mean."""
    size = len(costs) // len(parts)
    before = [sum(costs[i : i + size]) for i in range(0, len(costs), size)]
    after = [sum(costs[i] for i in p) for p in parts]
    values = {"min": min(before), "max": max(before), "minmax_diff": max(before) - min(before), "balanced_min": min(after), "balanced_max": max(after), "mean": sum(before) / len(parts)}
    return {f"{prefix}/{k}": v for k, v in values.items()}


def inverse(order: list[int]) -> list[int]:
    """Where each item of a permutation came from."""
    out = [0] * len(order)
    for place, i in enumerate(order):
        out[i] = place
    return out


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, b: int) -> int:
    return ceil_div(a, b) * b


def group_balanced(costs: list[int], uids: list, k: int) -> list[list[int]]:
    """Runs of equal uids stay together."""
    runs: list[list[int]] = []
    for i, u in enumerate(uids):
        if i and u == uids[i - 1]:
            runs[-1].append(i)
        else:
            runs.append([i])
    parts = karmarkar_karp([sum(costs[i] for i in r) for r in runs], k)
    return [[i for r in part for i in runs[r]] for part in parts]


def micro_batches(lengths: list[int], max_tokens: int, least: int = 1, divided_by: int = 1) -> list[list[int]]:
    """Batches of balanced workload: as many as the tokens need, at least `least`, rounded up to a multiple; in order small, large, small."""
    if max(lengths, default=0) > max_tokens:
        raise ValueError("a sequence is longer than a batch may be")
    n = min(len(lengths), max(-(-sum(lengths) // max_tokens), least))
    n = min(len(lengths), -(-n // divided_by) * divided_by)
    parts = karmarkar_karp([workload(x) for x in lengths], n)
    parts.sort(key=lambda p: (-sum(workload(lengths[i]) for i in p), p[0] if p else 0))
    return parts[::2][::-1] + parts[1::2]


def zigzag(part: list[int], lengths: list[int]) -> list[int]:
    """Inside a worker: up by workload, then down."""
    p = sorted(part, key=lambda i: (workload(lengths[i]), i))
    return p[::2] + p[1::2][::-1]


def plan(df: DataFrame, batch: Column | str, length: str, key: str, k: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """(batch, key, part, place) for every row: k balanced parts of each batch, or micro batches under max_tokens."""
    kind = df.schema[key].dataType.simpleString()
    name = batch if isinstance(batch, str) else "batch"
    df = df if isinstance(batch, str) else df.withColumn("batch", batch)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        lengths = rows[length].astype(int).tolist()
        parts = micro_batches(lengths, max_tokens) if max_tokens else karmarkar_karp([workload(x) for x in lengths], k)
        found = [(i, p, j) for p, part in enumerate(parts) for j, i in enumerate(zigzag(part, lengths))]
        order = [f[0] for f in found]
        return pd.DataFrame({name: rows[name].iloc[order].to_numpy(), key: rows[key].iloc[order].to_numpy(), "part": [f[1] for f in found], "place": [f[2] for f in found]})

    return df.select(name, key, length).groupBy(name).applyInPandas(run, f"{name} {df.schema[name].dataType.simpleString()}, {key} {kind}, part int, place int")
