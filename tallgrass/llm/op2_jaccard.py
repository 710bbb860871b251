"""N-gram Jaccard join by multiple-global-order filtering, as classes of documents.

A document is its set of five-word shingles. Equal sets are one class. In any global order of tokens the first n - ceil(0.8 n) + 1 tokens of two sets of similarity
0.8 share a token. The first order puts tokens that stand in a great many documents last and orders the rest by hash: so common passages fill no buckets, and
sets are joined on their prefix tokens. Candidates have to share prefix tokens under ORDERS further orders before their sets are compared in full (see linking).

Scale: texts are read three times (signatures, postings, texts of candidates); the first shuffle holds a fifth of all tokens, at most one row for each task and
set. The tokens that go last reach the tasks as a broadcast: they stand in at least one of FREQUENT documents (64 at least), so there are at most FREQUENT times a
document's mean number of tokens, whatever the size of the corpus. Any choice of them is right, since it holds for all documents alike.

Null or empty text, or none but white space: n_shingles 0, linked with nothing. Rows of one doc_id count as one document. Null doc_id: component_id null, linked
with nothing. Other columns are not read, and clean_documents() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import by_slices, columns_of, held, materialize, may_have, mix64, table, without_rows
from tallgrass.llm.linking import in_several, link, partners, prefix_size, sketch, small_sketch
from tallgrass.llm.shingles import set_id, sets_of

ORDERS, FREQUENT = 2, 4096
#: Tokens of different sets that are counted together, 32 MB of a task.
COUNTED = 1 << 22
_SIGNATURE = "doc_id long, sid long, n long, sketch binary, small binary, token long, times long"


def signatures(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, sid, n, sketch, small), and rows (token, times) for tokens that stand in several different sets among those that are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("op2", dict)  # what earlier operators keep goes
        tokens, used, seen = np.empty(COUNTED, dtype=np.uint64), 0, set()
        for batch in batches:
            sids, ns, sketches = [], [], []
            for values in sets_of(batch.column(1)):
                sids.append(set_id(values))
                ns.append(len(values))
                sketches.append(sketch(values))
                if sids[-1] not in seen:
                    if used + len(values) > len(tokens):
                        yield _repeated(tokens[:used])
                        used = 0
                        seen.clear()
                    seen.add(sids[-1])
                    some = values[: len(tokens)]  # counts only choose an order
                    tokens[used : used + len(some)] = some
                    used += len(some)
            rows = len(sids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.int64()), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()), pa.array([small_sketch(x) for x in sketches], pa.binary()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=NAMES)
        yield _repeated(tokens[:used])

    return docs.mapInArrow(by_slices(run), _SIGNATURE)


def _repeated(tokens: np.ndarray) -> pa.RecordBatch:
    """Rows (token, times) of those that stand there several times. Sorts them where they are."""
    tokens.sort()
    found, times = np.unique(tokens[1:][tokens[1:] == tokens[:-1]], return_counts=True)
    none = [pa.nulls(len(found), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([*none, pa.array(found.view(np.int64)), pa.array(times + 1)], names=NAMES)


NAMES = ["doc_id", "sid", "n", "sketch", "small", "token", "times"]


def frequent_tokens(signed: DataFrame, documents: int) -> np.ndarray:
    """Sorted tokens that go last in the first order."""
    least = max(64, documents // FREQUENT)
    found = signed.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("token")
    return np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *(token for token, in columns_of(found))]).view(np.uint64))


def first_order_prefix(values: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The prefix of a set under (frequent, hash)."""
    p = prefix_size(len(values))
    ranks = mix64(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
    if len(last):
        at = np.minimum(np.searchsorted(last, values), len(last) - 1)
        ranks |= (last[at] == values).astype(np.uint64) << np.uint64(63)
    return values[np.argpartition(ranks, p - 1)[:p]] if p < len(values) else values


def postings(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """(token, sid) for the prefix tokens of every set, once for each task."""
    shared_last = docs.sparkSession.sparkContext.broadcast(last.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = np.frombuffer(shared_last.value, dtype=np.uint64), set()
        for batch in batches:
            tokens, sids = [], []
            if len(seen) > 1_000_000:
                seen.clear()
            for values in sets_of(batch.column(1)):
                sid = set_id(values)
                if len(values) and sid not in seen:
                    seen.add(sid)
                    tokens.append(first_order_prefix(values, last))
                    sids.append(np.full(len(tokens[-1]), sid, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sids))], names=["token", "sid"])

    return docs.mapInArrow(by_slices(run), "token long, sid long")


def join_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, labels, sizes): (doc_id, n, rep) of every document, where rep is the smallest id with the same set; components (id, label) of representatives; sizes (id, n) of their sets."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialize(signatures(docs), "op2-signed")
    rows = signed.where("token IS NULL").select("doc_id", "sid", "n", "sketch", "small")
    last = frequent_tokens(signed, rows.count())
    reps = materialize(rows.where("doc_id IS NOT NULL AND n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.first("small").alias("small")), "op2-classes")
    every = materialize(postings(docs, last), "op2-postings")
    several = materialize(in_several(every, "token", "sid"), "op2-tokens")
    # written before they are made distinct: a join without an aggregate behind it can split a hot token's rows
    some = every.where(may_have(docs.sparkSession, several)(F.col("token")))
    met = materialize(some.join(several.hint("merge"), "token").select("token", "sid"), "op2-met").distinct()
    buckets = met.join(reps.select("sid", "id"), "sid").select("token", "id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    sketches = reps.groupBy("id").agg(F.max(F.struct("n", "sketch", "small")).alias("x")).select("id", "x.n", "x.sketch", "x.small")
    labels, _ = link(buckets, texts, sketches, ORDERS)
    named = rows.join(reps.select("sid", "n", F.col("id").alias("rep")), ["sid", "n"], "left")
    return named.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), labels, sketches.select("id", "n")


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: how many different texts, one for each representative, are similar to the document's."""
    rows, labels, sizes = join_classes(docs)
    labels = materialize(labels, "op2-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    degree = partners(labels, texts, sizes).withColumnRenamed("id", "rep")
    out = rows.join(labels, rows["rep"] == labels["id"], "left").join(degree, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with all columns; documents without words or id stay."""
    rows, labels, _ = join_classes(docs)
    gone = rows.join(labels, rows["rep"] == labels["id"], "left").where(F.coalesce("label", "rep") != F.col("doc_id")).select("doc_id").distinct()
    return without_rows(docs, materialize(gone, "op2-gone"), {"doc_id": F.col("doc_id").cast("long")})


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op2_jaccard": op2_jaccard}
ORACLES: dict[str, str] = {}
