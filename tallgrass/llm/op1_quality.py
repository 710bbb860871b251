"""Quality classifier: random Fourier features of document statistics, ridge regression by partition-summed normal equations, isotonic calibration.

Statistics of every whole text (lengths, character classes, repetition, line shape) are standardized and mapped to COMPONENTS random Fourier features, which
approximate a Gaussian kernel. Each partition of the training rows gives its sums of z z' and z y; the driver adds a bounded number of them and solves the ridge
system. A part of the training rows is kept back from the fit, and isotonic regression on it turns ridge scores into probabilities.

Scale: one pass over texts, which gives a few numbers for each document; labels are joined to those. The fit uses at most TRAIN_ROWS labelled rows (chosen by hash
of their id, the same at every run); statistics and scores cover all documents.

Null or empty text: scored like any other, as a text of length 0. Null doc_id: scored, held_out null. Repeated rows repeat. Labels that are null or without an id
are left out; of several labels of one id the largest counts. With no labels of both kinds, every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import calibration
from tallgrass.llm.common import crc_bucket, materialize, table

COMPONENTS, TRAIN_ROWS, RIDGE, WIDTH, PARTS, PIECE = 384, 60_000, 1e-3, 2.0, 32, 1 << 16
THRESHOLD = 0.7
_NOT_LETTER = re.compile(r"[^\w\s]")
_MARKS = re.compile(r"[%$&*#|~^<>{}\\=_]")
_ENDS = re.compile(r"[.!?][\"')]*(?:\s|$)")
NAMES = ("log_chars", "log_words", "word_mean", "word_std", "upper", "digit", "punct", "exclaim", "marks", "distinct", "top", "again", "log_lines", "log_line_words", "deflate", "capital_words", "single", "sentence", "spaces", "line_repeat", "pair_distinct", "longest")


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; all of them are bounded or logarithmic."""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(NAMES) - 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=m)
    counts = Counter(words)
    again = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    # compressed in pieces, so that long texts compare with short ones
    packed = sum(len(zlib.compress(raw[i : i + PIECE], 1)) for i in range(0, len(raw), PIECE))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = n - int(m)
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        min(float(sizes.mean()), 40.0),
        min(float(sizes.std()), 40.0),
        upper / letters if letters > 0 else 0.0,
        sum(map(str.isdigit, text)) / n,
        len(_NOT_LETTER.findall(text)) / n,
        text.count("!") / m,
        len(_MARKS.findall(text)) / m,
        len(counts) / m**0.8,
        counts.most_common(1)[0][1] / m,
        again / m,
        float(np.log1p(len(lines))),
        float(np.log1p(m / len(lines))),
        packed / max(len(raw), 1),
        sum(map(str.isupper, words)) / m,
        float((sizes == 1).sum()) / m,
        len(_ENDS.findall(text)) / m,
        1 - sizes.sum() / n,
        1 - len(set(lines)) / len(lines),
        len(set(zip(words, words[1:], strict=False))) / max(m - 1, 1),
        float(np.log1p(sizes.max())),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x: array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, type=pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """mean, scale: of the statistics; w, b: the random features; beta: ridge weights; knots: the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([out, z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return calibration.apply(self.knots, self.features(x) @ self.beta) if len(x) else np.zeros(0)


def _rows(batch: pa.RecordBatch, k: int) -> np.ndarray:
    column = batch.column(k)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums over partitions of z z' and z y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz, zy = 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(_rows(batch, 0)), np.asarray(batch.column(1), dtype=float)
                zz, zy = zz + z.T @ z, zy + z.T @ y
        if not np.isscalar(zz):
            yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()]), pa.array([zy.tobytes()])], names=["zz", "zy"])

    zz, zy = 0.0, 0.0
    for r in train.select("x", "y").coalesce(PARTS).mapInArrow(run, "zz binary, zy binary").toLocalIterator():
        zy = zy + np.frombuffer(r.zy)
        zz = zz + np.frombuffer(r.zz).reshape(len(np.frombuffer(r.zy)), -1)
    return zz, zy


def fit(labelled: DataFrame, seed: int = 11) -> Model | None:
    """A model from rows (doc_id, x, y); None without labels of both kinds."""
    train = labelled.where("x IS NOT NULL AND y IS NOT NULL")
    n = train.count()
    if n > TRAIN_ROWS:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    train = materialize(train.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4))), "op1-train")
    kinds = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return None
    moments = train.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    mean, scale = np.array([r.m for r in moments]), np.array([max(r.s, 1e-6) for r in moments])
    rng = np.random.default_rng(seed)
    d = len(mean)
    model = Model(mean, scale, rng.normal(size=(d, COMPONENTS)) / (WIDTH * np.sqrt(d)), rng.uniform(0, 2 * np.pi, COMPONENTS), np.zeros(0), (np.zeros(0), np.zeros(0)))
    zz, zy = _sums(train.where("part > 0"), model)
    if np.isscalar(zz):
        return None
    # the last feature is 1, so its sum of squares is the number of rows summed
    model.beta = np.linalg.solve(zz + RIDGE * zz[-1, -1] * np.eye(len(zz)) / len(zz) + 1e-9 * np.eye(len(zz)), zy)
    back = train.where("part = 0").select("x", "y").toPandas()
    if len(back):
        model.knots = calibration.isotonic(np.round(model.features(np.vstack(back["x"].to_numpy())) @ model.beta, 6), back["y"].to_numpy())
    return model


def score_documents(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, 0.5) if model is None or not batch.num_rows else np.clip(model.score(_rows(batch, 1)), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = materialize(document_statistics(docs), "op1-statistics")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y")).where(crc_bucket("doc_id", 4) != 2)
    model = fit(stats.join(known, "doc_id"))
    scored = score_documents(stats, model)
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
