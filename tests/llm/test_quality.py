import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import calibration, op1_quality
from tallgrass.llm.common import crc_bucket, table

SMALL = "/root/testdata/sf0.01"


def test_isotonic_is_monotone_and_pools():
    x, y = calibration.isotonic(np.array([1, 2, 3, 4, 4, 5.0]), np.array([0, 1, 0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all() and y.min() > 0 and y.max() < 1
    assert calibration.apply((x, y), np.array([0.0, 9.0])).tolist() == [y[0], y[-1]]
    assert calibration.apply((np.zeros(0), np.zeros(0)), np.array([1.0])).tolist() == [0.5]


@pytest.mark.parametrize("text", ["", " ", "a", "!!!", "a a a a", "Ünï cödé\n\n\nx", "x" * 200_000, "word " * 40_000])
def test_statistics_are_finite(text):
    x = op1_quality.statistics(text)
    assert len(x) == len(op1_quality.NAMES) and np.isfinite(x).all()


def test_normal_equations_match_a_direct_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] > 0).astype(float)
    model = op1_quality.Model(x.mean(0), x.std(0), rng.normal(size=(3, 8)), rng.uniform(0, 6, 8), np.zeros(0), (np.zeros(0), np.zeros(0)))
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    zz, zy = op1_quality._sums(rows, model)
    z = model.features(x)
    assert np.allclose(zz, z.T @ z) and np.allclose(zy, z.T @ y)


def test_held_out_accuracy(spark):
    got = op1_quality.op1_quality(spark, SMALL)
    both = got.join(table(spark, SMALL, "labels"), "doc_id").where("held_out").toPandas()
    assert (both.predicted == both.quality).mean() > 0.9
    one = both[both.quality == 1].score.mean() - both[both.quality == 0].score.mean()
    assert one > 0.4
    assert got.where(~F.col("score").between(0, 1)).count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "a b", 1), (2, "", 2), (2, "", 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = op1_quality.quality_scores(docs, labels).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {0}
    assert op1_quality.quality_scores(docs.limit(0), labels).count() == 0
    assert docs.where(crc_bucket("doc_id", 4) == 2).count() <= 4


def test_ridge_follows_the_rows_summed(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1600, 3))
    labelled = spark.createDataFrame([(i, r.tolist(), float(r[0] > 0)) for i, r in enumerate(x)], "doc_id long, x array<double>, y double")
    monkeypatch.setattr(op1_quality, "COMPONENTS", 16)
    chosen = op1_quality.fit(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 125_000))
    monkeypatch.setattr(op1_quality, "TRAIN_ROWS", 200)
    assert np.allclose(op1_quality.fit(labelled).beta, chosen.beta, rtol=1e-6)
