"""Retrieval: exact inner-product search and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows of corpus (id, vec) for every row of queries (query_id, vec). Queries are taken in blocks of BLOCK vectors; every task keeps the k best of its rows for each query, and only those are shuffled."""
    ids = [r.query_id for r in queries.select("query_id").orderBy("query_id").collect()]
    best = None
    for s in range(0, len(ids), BLOCK):
        block = queries.where(F.col("query_id").between(ids[s], ids[min(s + BLOCK, len(ids)) - 1])).collect()
        shared = corpus.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in block]), np.array([r.vec for r in block], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                held.append((np.asarray(batch.column(0)), q @ x.T))
                names = np.concatenate([h[0] for h in held])
                scores = np.concatenate([h[1] for h in held], axis=1)
                order = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
                keep = np.unique(order)
                held = [(names[keep], scores[:, keep])]
            if held:
                names, scores = held[0]
                order = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, order.shape[1])), pa.array(names[order].ravel()), pa.array(np.take_along_axis(scores, order, 1).ravel())], names=["query_id", "id", "score"])

        part = corpus.select("id", "vec").mapInArrow(run, "query_id long, id long, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return corpus.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query_id, id, score, rank) over corpus (id, contents) and queries (query_id, query). Terms are lower-case words; only postings of terms that a query has are counted."""
    terms = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    docs = corpus.select("id", terms(F.col("contents")).alias("t"))
    size = docs.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("t")).alias("_avg"))
    posting = docs.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = posting.groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(size))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    total = scored.groupBy("query_id", "id").agg(F.sum(s).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)
