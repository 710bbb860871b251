"""Toxicity by noisy-channel deobfuscation: the text is restored by Viterbi decoding (see deobfuscate), then scored.

The character language model counts the letter runs of every document. A restored text is scored by its distinct words: each word, and each beginning of one with
STEMS letters, has a weight, its smoothed log-odds among labelled documents; the score adds up a document's strongest few and is calibrated by isotonic regression.

Scale: three passes over texts (letter runs, of which a task holds those that occur, at most 28^5; words of labelled rows; scores). Weights are learned from at most
TRAIN_ROWS labelled rows, chosen by hash of their id, so they can be broadcast; the rest covers all rows. No word, token or text is cut or skipped: tokens that the
channel can't change (letters only, none doubled) restore to themselves, all others are decoded.

Null or empty text: no words, scored as such. Null doc_id: scored, held_out null. Repeated rows repeat; equal texts count once in the fit, and the larger label holds. Labels
that are null or without an id are left out, of several for one id the largest counts. Equal weights add up alike, so ties don't matter. Without labels of both kinds, or with an
empty table, every score is 0. Very long texts and tokens take time in proportion to their length. toxicity_scores() reads doc_id and text alone; clean_documents() keeps all
columns, and its helper column takes a name that none of them has.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm import calibration
from tallgrass.llm.common import by_slices, crc_bucket, fresh, held, materialize, small_batches, split_by, table
from tallgrass.llm.deobfuscate import CONTEXTS, SIZE, CharModel, Decoder, disguises, gram_codes, tokens

TRAIN_ROWS, LEAST, STRONGEST, STEMS = 40_000, 3, 4, (4, 5, 6)
THRESHOLD = 0.7
#: Bytes of tokens whose words a worker remembers.
MEMO = 12 << 20


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, ascending, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def letter_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n) of the letter runs of texts. Codes that occur are held, not a number for each that could: texts use a few thousandths of them."""
    codes, counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    for batch in batches:
        new, n = np.unique(gram_codes("  ".join(t or "" for t in batch.column(0).to_pylist()).lower()), return_counts=True)
        codes, counts = _added(np.concatenate([codes, new]), np.concatenate([counts, n]))
    for s in range(0, len(codes), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(codes[s : s + (1 << 17)].astype(np.int64)), pa.array(counts[s : s + (1 << 17)])], names=["code", "n"])


def char_model(docs: DataFrame) -> CharModel:
    """Letter runs of all documents, added up by code."""
    each = docs.select(F.col("text").cast("string")).mapInArrow(by_slices(letter_runs), "code long, n long")
    # at most 28^5 codes, of which a language uses few
    found = each.groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    return CharModel(found["code"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64))


def keys_of(words: set[str]) -> set[str]:
    """A document's evidence: its words, and their beginnings."""
    return words | {w[:k] + "*" for k in STEMS for w in words if len(w) > k}


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    knots: tuple[np.ndarray, np.ndarray]

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max(get(word, 0.0), *(get(word[:k] + "*", 0.0) for k in STEMS if len(word) > k), 0.0)


class Scorer:
    """A model with what a worker remembers of its tokens."""

    def __init__(self, model: Model):
        self.model, self.decoder = model, Decoder(model.chars)
        self.memo: dict[str, tuple[str, float] | None] = {}
        self.used = 0

    def _look(self, token: str) -> tuple[str, float] | None:
        word = self.decoder.word(token)
        w = self.model.weight(word) if word else 0.0
        found = (word, w) if w > 0 else None
        size = 150 + 4 * len(token)
        if size <= MEMO >> 8:
            if self.used + size > MEMO:
                self.memo.clear()
                self.used = 0
            self.used += size
            self.memo[token] = found
        return found

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The strongest weights of different words of each text, one for each word, added up."""
        out = np.zeros(len(texts))
        memo, look, none = self.memo, self._look, object()
        noisy, spaced = disguises(texts)
        for i, text in enumerate(texts.to_pylist()):
            if not text:
                continue
            text = text.lower()
            found: dict[str, float] = {}
            for t in tokens(text, noisy[i]):
                hit = memo.get(t, none)
                if hit is none:
                    hit = look(t)
                if hit is not None:
                    found[hit[0]] = hit[1]
            if spaced[i]:
                found |= {w: x for w in self.decoder.apart(text) if (x := self.model.weight(w)) > 0}
            out[i] = sum(sorted(found.values(), reverse=True)[:STRONGEST])
        return out


def log_odds(train: DataFrame, chars: CharModel) -> dict[str, float]:
    """Weights of evidence from rows (text, y), those that LEAST toxic documents or more hold and others hardly. Rows are at most TRAIN_ROWS, and so bound the weights."""
    shared, key = train.sparkSession.sparkContext.broadcast(chars), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = held(key, lambda: Decoder(shared.value))
        counts = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for y in (0, 1):
                if counts[y]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts[y]), type=pa.string()), pa.array(list(counts[y].values()), type=pa.int64()), pa.array([y] * len(counts[y]), type=pa.int32())], names=["k", "n", "y"])
                counts[y].clear()

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(y)].update(keys_of(decoder.words(text or "")))
            if len(counts[0]) + len(counts[1]) > 100_000:
                yield from out()
        yield from out()

    sizes = {int(r.y): r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    each = train.select("text", "y").mapInArrow(by_slices(run), "k string, n long, y int").groupBy("k").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    weight = F.log((F.col("t") + 0.1) / (sizes[1] + 1)) - F.log((F.col("c") + 1.0) / (sizes[0] + 1))
    # evidence that holds by itself: at least nine in ten of its documents are toxic
    kept = each.where((F.col("t") >= LEAST) & (F.col("t") >= 9 * F.col("c"))).select("k", weight.alias("w"), "t").where("w > 0")
    return {r.k: r.w for r in kept.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chars = char_model(docs)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("y")).where(crc_bucket("doc_id", 3) != 1)
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    # only labelled texts are moved
    labelled = split_by(docs, known.select("doc_id"))[1]
    train = labelled.join(known.hint("merge"), "doc_id").groupBy("text").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    # weights come from three quarters, the calibration from the rest
    train = materialize(train.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))), "op3-train")
    weights = log_odds(train.where("part > 0"), chars)
    model = Model(chars, weights, (np.zeros(0), np.zeros(0)))
    if weights:
        back = evidence(train.where("part = 0").select("doc_id", "text", "y"), model).join(train.select("doc_id", "y"), "doc_id").select("z", "y").toPandas()
        if len(back):
            model.knots = calibration.isotonic(np.round(back["z"].to_numpy(), 6), back["y"].to_numpy())
            # the calibration stands; now the rows that it was made on add their evidence
            model.weights = log_odds(train, chars)
    return model


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, z) of every row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1)))], names=["doc_id", "z"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(run), "doc_id long, z double")


def with_scores(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with a further column `name` of scores; none of them has that name."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(shared.value))
        knots = scorer.model.knots
        for batch in batches:
            z = scorer.scores(batch.column(at))
            score = np.clip(calibration.apply(knots, z), 0, 1) if len(knots[0]) else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return docs.mapInArrow(by_slices(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    scored = with_scores(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, "score")
    return scored.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    name = fresh("_toxicity", docs.columns)
    return with_scores(docs, fit(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
