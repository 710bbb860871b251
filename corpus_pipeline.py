"""A corpus from raw documents to token ids: five stages, each over all that the one before kept.

A stage is called with the session, the documents so far and the folder of the tables, and returns a DataFrame. run() writes each stage's result as Parquet into the
shared folder and reads it again for the next one. All but the last stage return the columns of documents.

1. toxicity: documents that the classifier predicts to be toxic go.
2. line_dedup: later repeated runs of lines go from texts; n_chars follows. A document of which nothing is left stays, with an empty text.
3. jaccard_join: of each class of similar documents the one with the smallest doc_id stays; documents without words or id stay.
4. decontaminate: documents in which a window of a benchmark item stands go.
5. bpe: every column, and token_ids and decoded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm import op2_jaccard, op3_toxicity, op4_lines, op7_bpe, op10_decontam
from tallgrass.llm.common import materialize, settle, table


def settled(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun by executors that have given back what the stage before it left."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return begun


@settled
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


@settled
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_lines.clean_texts(docs)


@settled
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_jaccard.clean_documents(docs)


@settled
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@settled
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_bpe.encode_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontaminate", decontaminate), ("bpe", bpe)]

#: A classifier and a tokenizer can't be put into SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
