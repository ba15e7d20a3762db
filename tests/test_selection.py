"""Exact quantiles by selection against numpy, on data that is hard for a sketch."""

import numpy as np
import pytest

from chartloom.operators import ordered

ASKED = {"lo": 0.0, "tenth": 0.1, "q1": 0.25, "mid": 0.5, "hi": 0.975, "top": 1.0}


def columns():
    rng = np.random.default_rng(3)
    yield "even", rng.normal(size=40_000)
    yield "sorted", np.arange(30_000.0)
    yield "tied", np.where(rng.random(20_000) < 0.4, 7.0, rng.integers(0, 20, 20_000)).astype(float)
    yield "one", np.array([4.5])
    yield "same", np.full(900, -2.0)
    yield "tail", np.concatenate([np.zeros(5_000), 10.0 ** rng.uniform(-9, 9, 300)])
    for n in range(2, 45):
        yield f"n{n}", rng.normal(size=n).round(1)


def test_quantiles_like_numpy(spark):
    data = dict(columns())
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("even", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    got = {r.k: r for r in ordered.quantiles(df, ["k"], "v", ASKED).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        assert [got[k][c] for c in ASKED] == pytest.approx(np.quantile(values, list(ASKED.values())).tolist(), rel=1e-12), k


def test_no_keys_and_no_rows(spark):
    df = spark.range(1001).selectExpr("CAST(id AS double) AS v")
    assert tuple(ordered.quantiles(df, [], "v", {"a": 0.25, "b": 0.9}).first()) == (250.0, 900.0)
    assert ordered.quantiles(df.limit(0), [], "v", {"a": 0.25}).count() == 0


def test_few_values_are_put_in_order(spark):
    df = spark.range(300_000).selectExpr("id % 2 AS k", "rand(7) AS v").cache()
    entries = ordered._bracketed(df, ["k"], "v", [0.025, 0.975])
    assert entries.agg({"_n": "sum"}).first()[0] == 300_000
    assert entries.count() < 0.03 * 300_000
