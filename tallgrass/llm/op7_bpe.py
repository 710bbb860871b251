"""BPE encoding and decoding of whole documents by a public vocabulary.

The vocabulary file (under 2 MB, read on the driver) is broadcast; rows are independent, so there is no shuffle. Batches are taken in slices of 1 MB, and
the words of a slice are merged together. Each Python worker keeps the results of words up to 16 MB, and beyond that those of the last slice: memory is bounded, results don't depend on it.

Null or empty text: no tokens, digests of nothing. Null doc_id stays null, repeated rows repeat, an empty table gives an empty one. Equal ranks in a word: the leftmost pair
merges first. Very long texts are one slice each; their time grows with n log n of their longest word. A text that holds a special token's string gets that token, as the
library does by default. encode_documents() keeps all columns but such as are named token_ids or decoded, which give way to its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.bpe import Bpe
from tallgrass.llm.common import by_slices, held, small_batches, table

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _model(model_json: str) -> Bpe:
    """One model for each worker process and vocabulary."""
    return held(("bpe", hash(model_json)), lambda: Bpe(model_json))


def _share(spark: SparkSession, vocabulary: str | None):
    small_batches(spark)
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every column of docs, and token_ids (array of int) and decoded (string) of its text."""
    shared = _share(docs.sparkSession, vocabulary)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("token_ids", "decoded")])
    at = docs.columns.index("text")
    types = pa.schema([("token_ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            pairs = list(model.encode_all(t or "" for t in batch.column(at).to_pylist()))
            ids = pa.ListArray.from_arrays(pa.array([0, *_sums(len(p[0]) // 4 for p in pairs)], type=pa.int32()), pa.Array.from_buffers(pa.int32(), sum(len(p[0]) // 4 for p in pairs), [None, pa.py_buffer(b"".join(p[0] for p in pairs))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([p[1] for p in pairs], type=pa.string())], names=[*batch.schema.names, *types.names])

    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(by_slices(run), schema)


def _sums(counts) -> list[int]:
    out, total = [], 0
    for n in counts:
        total += n
        out.append(total)
    return out


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, column: str = "token_ids") -> DataFrame:
    """(doc_id, token_ids) -> doc_id, decoded."""
    shared = _share(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], type=pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", column).mapInArrow(by_slices(run), "doc_id long, decoded string")


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    shared = _share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for a, b in model.encode_all(t or "" for t in batch.column(1).to_pylist()):
                n.append(len(a) // 4)
                ids.append(hashlib.sha256(a).hexdigest())
                decoded.append(hashlib.sha256(b.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(decoded, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(by_slices(run), DIGEST)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
