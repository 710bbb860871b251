"""Row algebra on frames with an explicit, dense row_id (0 .. n-1): order is data, never partition order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.durable import durable

ROW = "row_id"


class RowCountError(ValueError):
    """Frames that should hold the same rows don't."""


def number(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds row_id in the order given. Ranges are written once, so that they are the same at every read, and numbered where they lie; only their sizes reach the driver."""
    ranged = durable(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = {r._p: r.n for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    at, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    if not offsets:
        return df.withColumn(ROW, F.lit(0).cast("long"))
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _base long"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_r", rank).join(base, "_p").withColumn("_n", F.col("_base") + F.col("_r")).drop(ROW, "_p", "_r", "_base").withColumnRenamed("_n", ROW)


def select_rows(df: DataFrame, picks: DataFrame) -> DataFrame:
    """Gather: picks (pos, idx) names rows, duplicates allowed; row_id becomes pos."""
    return df.join(picks.select("pos", F.col("idx").alias(ROW)), ROW).drop(ROW).withColumnRenamed("pos", ROW)


def where_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where mask holds, renumbered densely."""
    return number(df.where(mask), ROW)


def slice_rows(df: DataFrame, n: int, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Python's slice of n rows, negative bounds and steps as well."""
    r = range(n)[slice(start, stop, step)]
    if len(r) == 0:
        return df.where(F.lit(False))
    lo, hi = min(r[0], r[-1]), max(r[0], r[-1])
    new = ((F.col(ROW) - r[0]) / r.step).cast("long")
    return df.where(F.col(ROW).between(lo, hi) & ((F.col(ROW) - lo) % abs(r.step) == 0)).withColumn(ROW, new)


def pop(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(popped, rest), each with row_id."""
    if missing := set(keys) - set(df.columns):
        raise KeyError(f"no such columns: {sorted(missing)}")
    return df.select(ROW, *keys), df.drop(*keys)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Horizontal union by row_id. Columns of both have to be equal (nulls and NaN equal themselves); a mismatch raises when the result is read."""
    both = [c for c in a.columns if c in b.columns and c != ROW]
    right = b.select(F.col(ROW).alias("_row"), *[F.col(c).alias(f"_b_{c}") if c in both else F.col(c) for c in b.columns if c != ROW])
    j = a.join(right, a[ROW] == F.col("_row"), "full_outer")
    checks = [F.when(F.col(ROW).isNull() | F.col("_row").isNull(), F.raise_error(F.lit("rows don't match")))]
    checks += [F.when(~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.raise_error(F.lit(f"column {c} differs"))) for c in both]
    checked = F.coalesce(*[c.cast("string") for c in checks])
    return j.withColumn(ROW, F.when(checked.isNull(), F.col(ROW))).drop("_row", *[f"_b_{c}" for c in both])


def concat(frames: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Vertical concatenation; the columns are the first frame's, and row_ids go on."""
    out, at = [], 0
    for df, n in zip(frames, sizes, strict=True):
        out.append(df.withColumn(ROW, F.col(ROW) + at))
        at += n
    return reduce(lambda x, y: x.unionByName(y.select(*frames[0].columns)), out)


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """permutation (pos, idx): row idx goes to pos."""
    return select_rows(df, permutation)


def repeat(df: DataFrame, n: int, times: int, interleave: bool = True) -> DataFrame:
    """aabb if interleaved, abab if not."""
    k = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_k")
    new = F.col(ROW) * times + F.col("_k") if interleave else F.col("_k") * n + F.col(ROW)
    return df.select("*", k).withColumn(ROW, new.cast("long")).drop("_k")


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """Every row as often as its own count says."""
    many = df.withColumn("_t", times.cast("int")).where("_t > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("_k"))
    return number(many.withColumnRenamed(ROW, "_old"), "_old", "_k").drop("_old", "_k", "_t")


def chunk(df: DataFrame, n: int, chunks: int, auto_padding: bool = False) -> DataFrame:
    """Adds chunk_id. Without auto_padding n has to be divisible; with it chunks have the ceiling of n / chunks rows."""
    if n % chunks and not auto_padding:
        raise ValueError(f"{n} rows don't make {chunks} equal chunks")
    return df.withColumn("chunk_id", F.floor(F.col(ROW) / -(-n // chunks)).cast("long"))


def split(df: DataFrame, size: int) -> DataFrame:
    """Adds chunk_id; the last chunk may be smaller."""
    return df.withColumn("chunk_id", F.floor(F.col(ROW) / size).cast("long"))


def pad_to_divisor(df: DataFrame, n: int, divisor: int) -> tuple[DataFrame, int]:
    """Rows from the head again, in a cycle, until the number is divisible; and how many."""
    pad = -n % divisor
    if not pad or not n:
        return df, 0
    k = F.explode(F.sequence(F.lit(0), F.lit(-(-pad // n) - 1))).alias("_k")
    extra = df.select("*", k).withColumn(ROW, (n + F.col("_k") * n + F.col(ROW)).cast("long")).where(F.col(ROW) < n + pad).drop("_k")
    return df.unionByName(extra), pad


def unpad(df: DataFrame, n: int, pad: int) -> DataFrame:
    return df.where(F.col(ROW) < n - pad)


def pad_rows(df: DataFrame, n: int, size: int, candidate: str = "last") -> DataFrame:
    """size more rows, copies of the first or the last."""
    k = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_k")
    extra = df.where(F.col(ROW) == (0 if candidate == "first" else n - 1)).select("*", k).withColumn(ROW, (n + F.col("_k")).cast("long")).drop("_k")
    return df.unionByName(extra) if size else df


def fold(df: DataFrame, n: int, groups: int, columns: list[str]) -> DataFrame:
    """n rows as `groups` rows of arrays."""
    size = n // groups
    packed = F.array_sort(F.collect_list(F.struct(ROW, *columns)))
    out = df.groupBy(F.floor(F.col(ROW) / size).cast("long").alias("_g")).agg(packed.alias("_x"))
    return out.select(F.col("_g").alias(ROW), *[F.col(f"_x.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Arrays of `size` as rows again."""
    z = df.select(ROW, F.posexplode(F.arrays_zip(*columns)).alias("_i", "_x"))
    return z.select((F.col(ROW) * size + F.col("_i")).cast("long").alias(ROW), *[F.col(f"_x.{c}").alias(c) for c in columns])


def unfold_column_chunks(df: DataFrame, n_split: int, columns: list[str]) -> DataFrame:
    """Array columns cut into n_split parts, a row for each; other columns are repeated."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n_split - 1))).alias("_k")
    cut = lambda c: F.slice(F.col(c), F.col("_k") * (F.size(c) / n_split).cast("int") + 1, (F.size(c) / n_split).cast("int"))
    out = df.select("*", k)
    return out.withColumns({c: cut(c) for c in columns} | {ROW: (F.col(ROW) * n_split + F.col("_k")).cast("long")}).drop("_k")


def mini_batches(df: DataFrame, n: int, size: int, epochs: int, seed: int | None = None) -> DataFrame:
    """(epoch, batch_id) for every row and epoch, in row order or, with a seed, in the order of a seeded hash."""
    if n % size:
        raise ValueError(f"{n} rows don't make batches of {size}")
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    if seed is None:
        return each.withColumn("batch_id", F.floor(F.col(ROW) / size).cast("long"))
    rank = F.row_number().over(Window.partitionBy("epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", ROW), ROW)) - 1
    return each.withColumn("batch_id", F.floor(rank / size).cast("long"))


def replicate(df: DataFrame, ranks: list[int]) -> DataFrame:
    """Scatter by mesh: rank r of ranks gets data-parallel shard ranks[r]; df has the shard as chunk_id."""
    spots: dict[int, list[int]] = {}
    for rank, shard in enumerate(ranks):
        spots.setdefault(shard, []).append(rank)
    at = F.create_map(*[x for k, v in spots.items() for x in (F.lit(k).cast("long"), F.array(*map(F.lit, v)))])
    return df.select("*", F.explode(F.element_at(at, F.col("chunk_id").cast("long"))).alias("rank"))


def assert_equal(a: DataFrame, b: DataFrame) -> None:
    if a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty():
        return
    raise AssertionError("frames differ")
