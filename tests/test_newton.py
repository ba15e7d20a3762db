"""The quadratic model of a Newton step is solved to the end, and a search of hard fits takes few steps."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from chartloom.operators import models, newton


def alike(rng, rows, size):
    """Features that come in near-equal pairs, like an n-gram and its words."""
    x = (rng.random((rows, size)) < 0.3).astype(float)
    for j in range(1, size, 2):
        x[:, j] = np.where(rng.random(rows) < 0.003, 1 - x[:, j - 1], x[:, j - 1])
    return x


def test_a_quadratic_model_of_alike_features_is_solved():
    rng = np.random.default_rng(5)
    x = alike(rng, 4000, 60)
    curves, penalty = x.T @ x / 4000, 1e-7
    gradient = -curves @ rng.normal(size=60) + 1e-4 * rng.normal(size=60)
    found = newton.descend(gradient, curves, np.zeros(60), penalty)
    slope = gradient + curves @ found
    slack = np.where(found != 0, np.abs(slope + penalty * np.sign(found)), np.maximum(np.abs(slope) - penalty, 0))
    assert slack.max() <= penalty * newton.EXACT          # 250 sweeps over the coordinates ended far from it


def test_equal_and_empty_features():
    curves = np.array([[1.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]])
    found = newton.descend(np.array([-1.0, -1.0, 0.0]), curves, np.zeros(3), 0.25)
    assert found[0] + found[1] == pytest.approx(0.75) and found[2] == 0
    opposed = newton.descend(np.array([-1.0, -1.0, 0.0]), curves, np.array([3.0, -3.0, 0.0]), 0.25)
    assert opposed[0] + opposed[1] == pytest.approx(0.75) and (opposed[:2] >= 0).all()
    assert (newton.descend(np.array([-0.1, 0.1, 0.0]), curves, np.zeros(3), 0.25) == 0).all()


def test_halved_and_whole():
    curves = np.array([[4.0, 1.0, 2.0], [1.0, 5.0, 3.0], [2.0, 3.0, 6.0]])
    assert (newton._whole(newton._halved(curves), 3) == curves).all()
    assert newton._whole(newton._halved(np.zeros((0, 0))), 0).shape == (0, 0)


def test_hard_fits_take_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = alike(rng, 600, 20)
    y = (x @ rng.normal(size=20) + rng.normal(size=600) > 0).astype(int)
    prepared = models.pack(models.prepare_classes(spark.createDataFrame(
        [(i, Vectors.dense(x[i]), int(y[i])) for i in range(600)], ["i", "features", "y"])))
    rows = models.pack(prepared.select("features_m", "label_m", (F.col("i") % 2).cast("int").alias("fold"),
                                       F.array("weight", "weight").alias("weights")))
    sums, passes = newton._sums, []
    monkeypatch.setattr(newton, "_sums", lambda *a: (passes.append(1), sums(*a))[1])
    settings = [(1 / (c * 300), fold) for c in (0.5, 50, 5000) for fold in range(2)]
    weights = newton.fit_settings(rows, settings)
    assert len(passes) <= 20
    data = rows.select(F.col("fold"), F.col("label_m"), F.col("weights")[0].alias("w"),
                       models.vector_to_array("features_m").alias("x")).collect()
    for (penalty, out), w in zip(settings, weights):
        held = [r for r in data if r["fold"] != out]
        z, own = np.array([r["x"] for r in held]), np.array([r["w"] for r in held])
        sign = np.array([2 * r["label_m"] - 1 for r in held])
        slope = -(own * sign / (1 + np.exp(sign * (z @ w)))) @ z / own.sum()
        slack = np.where(w != 0, np.abs(slope + penalty * np.sign(w)), np.maximum(np.abs(slope) - penalty, 0))
        assert slack.max() <= 1.01 * newton.EXACT * penalty
