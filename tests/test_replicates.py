"""Replicate vectors against rows repeated once per replicate."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.functions import hashing
from chartloom.operators import bootstrap, curves, metrics, replicates
from chartloom.operators.ordered import with_average_rank

N = 60


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(900):
        # a third of the rows agree in everything but the id, others have scores of their own
        hot = i % 3 == 0
        y = 1 if hot else rng.randrange(2)
        one = 0.5 if hot else rng.choice([round(rng.random(), 1), rng.random()])
        mrs = 4 if hot else rng.randrange(7)
        out.append((i, "a" if i % 5 else "b", y, 1 - one, one, rng.randrange(2), mrs, 2.5 if hot else mrs + rng.random() * 3))
    return spark.createDataFrame(out, "id long, band string, y int, zero double, one double, y_hard int, mrs int, y_pred double").repartition(3).cache()


def average_ranks(x):
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    until = np.cumsum(count)
    return (until - (count - 1) / 2)[inverse]


def test_weights_are_those_of_the_rows(spark, rows):
    drawn = {(r.id, r.rep): r.w for r in bootstrap.replicate(rows.select("id"), "id", N, 7).collect()}
    seeds = replicates.seeded(rows.select("id"), "id").collect()
    w = replicates.weights(np.array([r._row for r in seeds]), np.array([r._row2 for r in seeds]), N, 7)
    assert all(w[k, rep] == drawn.get((r.id, rep), 0) for k, r in enumerate(seeds) for rep in range(N))


def test_combined_keeps_all_weight(spark, rows):
    made = replicates.combined(replicates.seeded(rows, "id").coalesce(1), ["band", "mrs", "y_pred"], N, 7).collect()
    assert len(made) < len({(r.band, r.id) for r in rows.collect()}) - 200
    total = sum(np.array(r._w) if r._w is not None else replicates.weights(np.array([r._row]), np.array([r._row2]), N, 7)[0] for r in made)
    each = {r.rep: r.n for r in bootstrap.replicate(rows, "id", N, 7).groupBy("rep").agg(F.sum("w").alias("n")).collect()}
    assert [each[k] for k in range(N)] == list(total)


@pytest.mark.parametrize("keys", [[], ["band"]])
@pytest.mark.parametrize("partitions", [1, 8])
def test_spearman(spark, rows, keys, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {tuple(r[k] for k in keys): r for r in bootstrap.bootstrap_spearman(rows, "id", "mrs", "y_pred", keys, N, 42).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    drawn = bootstrap.replicate(rows, "id", N, 42).toPandas()
    for key, part in (drawn.groupby(keys) if keys else [((), drawn)]):
        values = []
        for _, rep in part.groupby("rep"):
            each = rep.loc[rep.index.repeat(rep.w)]
            values.append(np.corrcoef(average_ranks(each.mrs.to_numpy()), average_ranks(each.y_pred.to_numpy()))[0, 1])
        r = got[key]
        assert r.used == N and np.allclose([r.lo, r.hi], np.quantile(values, [0.025, 0.975]))


def test_rmse(rows):
    got = {r.band: r for r in bootstrap.bootstrap_rmse(rows, "id", "mrs", "y_pred", ["band"], N).collect()}
    drawn = bootstrap.replicate(rows, "id", N).toPandas()
    for band, part in drawn.groupby("band"):
        values = [np.sqrt((p.w * (p.mrs - p.y_pred) ** 2).sum() / p.w.sum()) for _, p in part.groupby("rep")]
        assert np.allclose([got[band].lo, got[band].hi], np.quantile(values, [0.025, 0.975]))


@pytest.mark.parametrize("keys", [[], ["band"]])
def test_binary(spark, rows, keys):
    got = {(*(r[k] for k in keys), r.scope, r.metric): r for r in bootstrap.bootstrap_binary(rows, "id", keys, N).collect()}
    drawn = bootstrap.replicate(rows, "id", N)
    both = {"0": (1 - F.col("y"), F.col("zero")), "1": (F.col("y"), F.col("one"))}
    areas = curves.curve_areas(curves.stacked(drawn, both, [*keys, "rep", "w"]), [*keys, "rep", "scope"], "truth", "score", "w").toPandas()
    for name, column in (("AUROC", "auroc"), ("AP", "ap"), ("AUPRC", "auprc")):
        for key, part in areas.groupby([*keys, "scope"]):
            r = got[(*(key if isinstance(key, tuple) else (key,)), name)]
            assert np.allclose([r.lo, r.hi], np.clip(np.quantile(part[column], [0.025, 0.975]), 0, 1))
    cells = drawn.groupBy(*keys, "rep").agg(*metrics.count_cells(drawn, keys, "y", "y_hard", "w")).toPandas()
    cells["F1"] = 2 * cells.tp / (2 * cells.tp + cells.fp + cells.fn)
    for key, part in (cells.groupby(keys) if keys else [((), cells)]):
        r = got[(*key, "1", "F1")]
        assert np.allclose([r.lo, r.hi], np.quantile(part.F1, [0.025, 0.975]))


def test_single_class_replicates_are_left_out(spark):
    few = spark.createDataFrame([(1, 1, 0.3, 0.7, 1), (2, 0, 0.6, 0.4, 0), (3, 0, 0.1, 0.9, 1)], "id long, y int, zero double, one double, y_hard int")
    used = {r.used for r in bootstrap.bootstrap_binary(few, "id", replicates=200).collect()}
    drawn = bootstrap.replicate(few, "id", 200).groupBy("rep").agg(F.countDistinct("y").alias("n")).where("n = 2").count()
    assert used == {drawn} and 0 < drawn < 200


def test_ranks_ride_on_the_rows(spark, rows):
    ranked = with_average_rank(rows.withColumn("w", F.lit(1)), ["band"], "y_pred", "w", "r")
    table = ranked.toPandas()
    for _, part in table.groupby("band"):
        assert np.allclose(part.r, average_ranks(part.y_pred.to_numpy())) and set(part.r_all) == {len(part)}


def test_rank_correlation_joins_on_no_value(spark, rows):
    plan = metrics.spearman(rows, [], "mrs", "y_pred")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ("mrs" in line or "y_pred" in line)]


def test_no_row_is_repeated_per_replicate(spark, rows):
    for made in (bootstrap.bootstrap_spearman(rows, "id", "mrs", "y_pred", [], N), bootstrap.bootstrap_binary(rows, "id", [], N)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(0" not in plan and "explode(" not in plan


@pytest.mark.parametrize("stretch, block", [(4096, 1024), (16, 50)])
def test_resample_like_a_row_per_draw(spark, monkeypatch, stretch, block):
    monkeypatch.setattr(bootstrap, "STRETCH", stretch)
    monkeypatch.setattr(bootstrap, "DRAW_ROWS", block)
    df = spark.createDataFrame([(3 * i, f"t{i % 7}" if i % 5 else None, i / 7) for i in range(230)], "i long, t string, v double").repartition(3)
    n = df.count()
    every = hashing.with_row_seeds(spark.range(N * n).withColumn("rep", (F.col("id") / n).cast("int")), F.col("id") % n)
    times = (hashing.with_draw(every, "rep", 9, "_draw").select("rep", (F.col("_draw") * n / hashing.PRIME).cast("long").alias("position"))
             .groupBy("rep", "position").agg(F.count(F.lit(1)).alias("w")))
    want = times.join(bootstrap.positions(df, "i").drop("position_count"), "position").drop("position")
    got = bootstrap.resample(df, "i", N, 9)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.agg(F.sum("w")).first()[0] == N * n
    # rows are drawn in blocks; there is no row per draw before the rows drawn
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f"Range (0, {n}," in plan


def test_resample_odd_rows(spark):
    none = spark.createDataFrame([], "i long, v double")
    assert bootstrap.resample(none, "i", 5).collect() == []
    twice = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (None, 4.0)], "i long, v double")
    got = bootstrap.resample(twice, "i", 40)
    assert got.where("i IS NULL").count() == 0 and got.where("i = 2 AND v IS NULL").count() > 10
