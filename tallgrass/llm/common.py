"""What the text operators share: table access, words, hashes, durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.sources.durable import discard, durable  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    return durable(df, name)


def fresh(name: str, *taken: Iterable[str]) -> str:
    """name, with underscores added until no column of `taken` has it (names are compared without regard to case, as Spark does)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


#: Bytes of a batch that an operator handles at once; what it builds from them is a small multiple.
SLICE = 1 << 20
_STATE: dict[object, object] = {}
_OWNER: list[str] = []


def held(key: object, build: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: the state of one operator at a time, so that the workers of a job with many operators stay small."""
    if key not in _STATE:
        _STATE.clear()
        release()
        _STATE[key] = build()
    return _STATE[key]


def enter(owner: str) -> None:
    """From here on a worker runs `owner`: what it kept for another function goes before anything is built beside it."""
    if _OWNER != [owner]:
        _OWNER[:] = [owner]
        if _STATE:
            _STATE.clear()
            release()


def release() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes, of one row at least."""
    if batch.num_rows <= 1 or batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), size)
    yield from slices(batch.slice(half), size)


def by_slices(run: Callable, size: int = SLICE) -> Callable:
    """A function over Arrow batches that gets them in slices, one after another, and leaves no memory behind but what is held() for its next task."""
    owner = uuid.uuid4().hex

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        try:
            yield from run(part for batch in batches for part in slices(batch, size))
        finally:
            release()

    return outer


#: Bytes after which Spark ends an Arrow batch.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches end after BATCH bytes. By default one holds 10,000 rows, in the executor and again in its worker, while slices of it are handled; rows and results are the same."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def settle(spark: SparkSession) -> None:
    """Executors collect their garbage and give free heap back to the system, each in a task for every core; no row or table is touched.

    A JVM keeps the heap that its busiest operator needed (and buffers outside it until their owners are collected). Between the operators of one job it stood
    beside the Python workers of the next one. On a cluster that is busy with other jobs some executors may get no task; then they stay as they are.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def crc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split by which labels are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; x is uint64 and not changed."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the offsets of its rows; null counts as empty. No copy where it can be helped."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def columns_of(df: DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of numbers of df, batch by batch: the driver holds so many bytes as the numbers have, never an object for each row."""
    for batch in df.toArrow().to_batches():
        yield tuple(np.asarray(c) for c in batch.columns)
    release()


#: Least and most bits of the filter by which rows that a join can't concern are left where they are, bits for each key, and bits that come to the driver at once. At most 32 MB are broadcast, whatever the corpus.
FILTER_LEAST, FILTER_MOST, FILTER_EACH, FILTER_PART = 1 << 20, 1 << 28, 16, 1 << 25


def slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(bits))


def key_bits(keys: DataFrame, hashed: bool = False) -> np.ndarray:
    """A bit set with a bit for each key's hash (keys: one column of longs; if they are hashed already, for their last bits). Its length follows the number of keys up to FILTER_MOST bits; with very many keys it lets many others through too."""
    key = F.col(keys.columns[0])
    n = keys.count()
    bits = FILTER_LEAST
    while bits < min(FILTER_EACH * n, FILTER_MOST):
        bits *= 2
    at = key.bitwiseAND(F.lit(bits - 1)) if hashed else slot(key, bits)
    words = keys.where(key.isNotNull()).select(at.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(s, 64) AS int))) AS b"))
    words = words.select(F.col("w").cast("int").alias("w"), "b")
    out, width = np.zeros(bits // 64, dtype=np.uint64), FILTER_PART // 64
    # of a large filter the words are written once and read part by part, so that the driver never holds them all beside the filter
    whole = len(out) <= width
    words = words if whole else materialize(words, "key-bits")
    for s in range(0, len(out), width):
        for w, b in columns_of(words if whole else words.where(F.col("w").between(s, s + width - 1))):
            out[w] = b.view(np.uint64)
    if not whole:
        discard(words)
    return out


def has_bits(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these hashes (signed or not) have their bit."""
    s = hashes.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) > 0


def may_have(spark: SparkSession, keys: DataFrame) -> Callable[[Column], Column]:
    """A condition on a column of longs: true for all keys, and for few others. Only the column passes through Python."""
    words = key_bits(keys)
    shared, bits = spark.sparkContext.broadcast(words), 64 * len(words)

    @F.pandas_udf("boolean")
    def has(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy(dtype=np.int64).astype(np.uint64)
        have = shared.value
        return pd.Series((have[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) > 0)

    return lambda key: has(slot(F.coalesce(key.cast("long"), F.lit(0)), bits))


def split_by(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id is not in ids, the others): the others hold all rows with one of these ids, and few more."""
    flag = may_have(docs.sparkSession, ids)(F.col("doc_id"))
    return docs.where(~flag), docs.where(flag)


def without_lines(docs: DataFrame, gone: DataFrame, count: str) -> DataFrame:
    """docs with `text` less the lines that gone (doc_id, place) names, places counted from 0, and the column `count`, the number of lines that went (0: the text is as it was).

    Texts that lose nothing are not moved. The join of the others sorts and merges at every size. Names of helper columns give way to those of docs.
    """
    key, places = fresh("_doc", docs.columns, [count]), fresh("_places", docs.columns, [count])
    gone = gone.select(F.col("doc_id").alias(key), "place")
    rest, touched = split_by(docs, gone.select(key).distinct())
    of_doc = gone.groupBy(key).agg(F.collect_set(F.col("place").cast("int")).alias(places))
    out = touched.join(of_doc.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left")
    # one pass over the lines: the places that stay are a difference of sets
    both = F.array(F.struct(F.split("text", "\n").alias("l"), F.col(places).alias("p")))
    kept = F.get(F.transform(both, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["p"]), lambda i: F.get(x["l"], i)), "\n")), 0)
    text = F.when(F.col(key).isNull(), F.col("text")).otherwise(kept).alias("text")
    n = F.greatest(F.coalesce(F.size(places), F.lit(0)), F.lit(0)).alias(count)
    out = out.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns], n)
    return rest.withColumn(count, F.lit(0)).unionByName(out)


def without_rows(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs less the rows that gone names. gone has the columns that keys names, the first of them an id; keys says how a row of docs gives them. Rows that can't be meant are not moved."""
    first = next(iter(keys))
    rest, touched = split_by(docs, gone.select(first).distinct())
    names = {k: fresh(f"_key_{k}", docs.columns) for k in keys}
    gone = gone.select(*[F.col(k).alias(names[k]) for k in keys])
    same = None
    for k, c in keys.items():
        one = c.eqNullSafe(F.col(names[k]))
        same = one if same is None else same & one
    return rest.unionByName(touched.join(gone.hint("merge"), same, "left_anti"))
