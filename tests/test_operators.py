import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.functions import labels
from chartloom.operators import bootstrap, curves, features, grouping, joins, metrics, models, ordered, report, split


@pytest.fixture
def many_ranges(spark):
    """Cut every order into ranges of a few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("descending", [False, True])
def test_ordered_scan_across_ranges(spark, many_ranges, descending):
    rng = random.Random(3)
    rows = [(k, float(v), rng.randint(1, 9), rng.choice([None, 1, 2, 3])) for k in "ab" for v in rng.sample(range(400), 60)]
    df = make(spark, rows, "k string, v double, n int, m int")
    assert len(ordered.range_bounds(df, "v")) > 5
    got = {(r.k, r.v): r for r in ordered.ordered_scan(
        df, ["k"], "v", descending=descending, sums=["n"], leads=["n"], down=["m"], up=["m"]).collect()}
    for k in "ab":
        line = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if descending else r[1])
        for i, r in enumerate(line):
            g = got[(k, r[1])]
            assert g.cum_n == sum(x[2] for x in line[: i + 1]) and g.all_n == sum(x[2] for x in line)
            assert g.next_n == (line[i + 1][2] if i + 1 < len(line) else None)
            assert g.prev_m == next((x[3] for x in reversed(line[: i + 1]) if x[3] is not None), None)
            assert g.foll_m == next((x[3] for x in line[i:] if x[3] is not None), None)


def test_quantiles_equal_numpy(spark, many_ranges):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k in "ab" for v in rng.integers(0, 30, 101)]
    out = ordered.quantiles(make(spark, rows, "k string, v double"), ["k"], "v", {"lo": 0.025, "q1": 0.25, "hi": 0.975, "max": 1.0})
    for r in out.collect():
        values = [v for k, v in rows if k == r.k]
        assert (r.lo, r.q1, r.hi, r.max) == pytest.approx(tuple(np.percentile(values, [2.5, 25, 97.5, 100])))


def _ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_spearman_with_ties_and_weights(spark, many_ranges):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 6), rng.randint(0, 20) / 4, rng.randint(0, 3)) for i in range(80)]
    df = make(spark, rows, "id int, t int, p double, w int")
    flat = [(t, p) for _, t, p, w in rows for _ in range(w)]
    for weight, pairs in ((None, [(t, p) for _, t, p, _ in rows]), ("w", flat)):
        wanted = np.corrcoef(_ranks([a for a, _ in pairs]), _ranks([b for _, b in pairs]))[0, 1]
        assert metrics.spearman(df, [], "t", "p", weight).first()["spearman"] == pytest.approx(wanted)
    constant = df.withColumn("t", F.lit(1))
    assert math.isnan(metrics.spearman(constant, [], "t", "p").first()["spearman"])


def test_areas_equal_brute_force(spark, many_ranges):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), rng.randint(0, 15) / 15) for _ in range(90)]
    r = curves.curve_areas(make(spark, rows, "y int, s double"), [], "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert r.auroc == pytest.approx(wins / len(pos) / len(neg))
    points = [(0.0, 1.0)]
    ap = 0.0
    for cut in sorted({s for _, s in rows}, reverse=True):
        tp, n = sum(s >= cut for s in pos), sum(s >= cut for _, s in rows)
        points.append((tp / len(pos), tp / n))
        ap += (points[-1][0] - points[-2][0]) * points[-1][1]
    area = sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(points, points[1:]))
    assert (r.ap, r.auprc) == (pytest.approx(ap), pytest.approx(area))


def test_macro_roc_equals_numpy_interpolation(spark, many_ranges):
    rng = random.Random(11)
    rows = [(s, rng.randint(0, 1), rng.randint(0, 25) / 25) for s in ("0", "1") for _ in range(70)]
    points = curves.roc_points(make(spark, rows, "scope string, y int, s double"), ["scope"], "y", "s")
    got = sorted((r.fpr, r.tpr) for r in curves.macro_roc(points, "scope", ["0", "1"]).collect())
    lines = {s: sorted((r.fpr, r.tpr) for r in points.collect() if r.scope == s) for s in ("0", "1")}
    grid = sorted({x for line in lines.values() for x, _ in line})
    mean = sum(np.interp(grid, [x for x, _ in line], [y for _, y in line]) for line in lines.values()) / 2
    assert [x for x, _ in got] == grid and [y for _, y in got] == pytest.approx(list(mean))
    assert curves.trapezoid_area(make(spark, got, "fpr double, tpr double")).first()["auc"] == pytest.approx(np.trapezoid(mean, grid))


def test_f1_threshold_takes_lowest_of_ties(spark):
    df = make(spark, [(1, 0.9), (0, 0.8), (0, 0.7), (1, 0.6), (0, 0.5)], "y int, s double")
    # F1 is 2/3 at 0.9 and at 0.6
    assert curves.f1_threshold(df, [], "y", "s").first()["threshold"] == 0.6
    assert curves.f1_threshold(df.withColumn("y", F.lit(0)), [], "y", "s").first()["f1"] == 0.0


def test_interval_join_hot_key(spark):
    notes = [(1 if i % 3 else i, i, i % 40) for i in range(300)]
    people = [(k, low, low + 10) for k in range(0, 300, 1) for low in (0, 20)]
    left = make(spark, people, "p int, low int, high int")
    lines = make(spark, notes, "p int, note int, at int")
    got = sorted((r.p, r.low, r.note) for r in joins.interval_join(left, lines, "p", "at", "low", "high").collect())
    assert got == sorted((p, low, note) for p, low, high in people for q, note, at in notes if p == q and low <= at <= high)


def test_null_safe_anti_join(spark):
    df = make(spark, [(1, None), (1, "a"), (2, None)], "k int, d string")
    assert [tuple(r) for r in joins.drop_listed_null_safe(df, df.where("k = 1 and d is null"), ["k", "d"]).collect()] in (
        [(1, "a"), (2, None)], [(2, None), (1, "a")])


def test_concat_order_null_and_partitioning(spark):
    rows = [("n", 3, "c"), ("n", 1, "a  a"), ("n", 2, None), (None, 1, "x")]
    for parts in (1, 4):
        df = make(spark, rows, "k string, i int, t string").repartition(parts)
        assert [tuple(r) for r in grouping.concat_ordered(df, ["k"], ["i"], "t", dedupe=True).collect()] == [("n", "a c")]


def test_latest_keeps_ties_and_drops_null_keys(spark):
    df = make(spark, [("a", 2, 1), ("a", 2, 2), ("a", 1, 3), (None, 9, 4)], "k string, d int, i int")
    assert sorted(r.i for r in grouping.latest_per_group(df, ["k"], "d").collect()) == [1, 2]


def test_having_total_is_a_semi_join(spark):
    df = make(spark, [("a", 299), ("b", 150), ("b", 150), (None, 900)], "k string, n int")
    assert [r.k for r in grouping.having_total(df, ["k"], F.col("n"), 300).collect()] == ["b", "b"]


def test_labels(spark):
    texts = ["3", "6 - Deceased", "Deceased", "4 - Moderately severe", "unknown", None]
    got = [r.v for r in make(spark, [(t,) for t in texts], "t string").select(labels.normalise_label(F.col("t")).alias("v")).collect()]
    assert got == [3.0, 6.0, 6.0, 4.0, None, None]
    row = make(spark, [(7.5, 1, None, 2.0)], "p double, e int, x double, z double").select(
        labels.override_prediction(labels.clip(F.col("p")), F.col("e")).alias("expired"),
        labels.override_prediction(F.col("p"), F.col("e"), F.col("z")).alias("extracted")).first()
    assert (row.expired, row.extracted) == (6.0, 2.0)


def test_split_is_by_entity_and_folds_match_dealing(spark, many_ranges):
    df = make(spark, [(i, i % 50) for i in range(400)], "i int, p int")
    sides = split.with_split(df, "p").groupBy("p").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert sides == 1
    sizes = split.contiguous_folds(df.limit(23), "i").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [5, 5, 5, 4, 4]


def test_strict_tenth_and_one_pass_ngrams(spark, monkeypatch):
    docs = [(i, "edge rare" if i == 0 else "common pair here" if i < 3 else "common other") for i in range(10)]
    df = make(spark, docs, "i int, t string")
    vocabulary = features.fit_ngram_vocabulary(df, "t")
    counts = {}
    for _, t in docs:
        w = t.split()
        for g in {" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}:
            counts[g] = counts.get(g, 0) + 1
    wanted = sorted((g for g, n in counts.items() if n * 10 > len(docs)), key=lambda g: (len(g.split()), g))
    assert vocabulary == wanted and "edge" not in vocabulary and "common pair here" in vocabulary


def test_rerange_rounds_half_to_even(spark):
    train = make(spark, [(0,), (10,)], "a int")
    test = make(spark, [(0,), (1,), (3,), (4,)], "a int")
    low, high = features.train_range(train, "a")
    own_low, own_high = features.train_range(test, "a")
    got = [r.v for r in test.select(features.rerange(F.col("a"), own_low, own_high, low, high).alias("v")).collect()]
    assert got == [0.0, 0.2, 0.8, 1.0]
    flat = make(spark, [(5,), (5,)], "a int")
    low, high = features.train_range(flat, "a")
    assert [r.v for r in flat.select(features.scale(F.col("a"), low, high).alias("v")).collect()] == [0.0, 0.0]


def test_poisson_weights_look_like_poisson(spark):
    df = make(spark, [(i, float(i % 5), float(i % 7)) for i in range(300)], "i int, t double, p double")
    r = bootstrap.replicate(df, "i", 200).agg(F.sum("w").alias("s"), F.max("w").alias("m")).first()
    assert r.s / (300 * 200) == pytest.approx(1.0, abs=0.02) and 5 <= r.m <= 11
    ci = bootstrap.bootstrap_rmse(df, "i", "t", "p", replicates=200).first()
    exact = bootstrap.interval(bootstrap.resample(df, "i", 200).groupBy("rep").agg(
        metrics.rmse_of(F.col("t"), F.col("p"), F.col("w")).alias("v")), [], "v").first()
    assert ci.lo == pytest.approx(exact.lo, rel=0.05) and ci.hi == pytest.approx(exact.hi, rel=0.05)
    single = df.withColumn("t", F.lit(1.0))
    assert bootstrap.bootstrap_rmse(single, "i", "t", "p", replicates=20).first()["used"] == 0


def test_micro_metrics_equal_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 1), p := rng.random(), 1 - p, int(p > 0.3)) for i in range(60)]
    got = {(r.scope, r.metric): r.value for r in bootstrap.binary_report(
        make(spark, rows, "i int, y int, one double, zero double, y_hard int")).collect()}
    accuracy = sum((r[2] > 0.5) == r[1] for r in rows) / 60
    for m in ("ACC", "Recall", "PPV", "F1", "Spec"):
        assert got[("micro", m)] == pytest.approx(accuracy)
    assert got[("macro", "AUPRC")] == got[("micro", "AUPRC")]


def test_bands_overlap(spark):
    df = make(spark, [(0,), (1,), (7,), (8,), (35,), (36,), (None,)], "d int")
    got = sorted((r.d, r.band) for r in report.with_bands(df, "d").collect())
    assert got == sorted([(0, "0"), (1, "(0,7]"), (7, "(0,7]"), (8, "(7,35]"), (8, ">7"), (35, "(7,35]"), (35, ">7"), (36, ">35"), (36, ">7")])


def test_lasso_equals_coordinate_descent(spark):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(0)
    x = (rng.random((120, 6)) > 0.6).astype(float)
    y = x @ np.array([2.0, 0, -1.5, 0, 0.4, 0]) + 1 + rng.normal(0, 0.1, 120)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "mrs"])
    model = models.lasso(0.05).fit(df)
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(6)
    for _ in range(500):
        for j in range(6):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / 120
            w[j] = math.copysign(max(abs(rho) - 0.05, 0), rho) / (xc[:, j] @ xc[:, j] / 120)
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-3)


def test_logistic_optimality(spark):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(1)
    x = (rng.random((150, 5)) > 0.5).astype(float)
    y = (x @ np.array([2.0, 0, -2.0, 0, 0]) + rng.logistic(0, 1, 150) > 0.5).astype(int)
    df = spark.createDataFrame([(Vectors.dense(a), int(b)) for a, b in zip(x, y)], ["features", "y"])
    c = 0.5
    model = models.fit_logistic(models.prepare_classes(df), c)
    w, xi = model.coefficients.toArray(), np.hstack([x, np.ones((150, 1))])
    weight = np.where(y == 1, 150 / (2 * y.sum()), 150 / (2 * (150 - y.sum())))
    gradient = c * xi.T @ (weight * (1 / (1 + np.exp(-xi @ w)) - y))
    for wj, g in zip(w, gradient):
        assert (g == pytest.approx(-np.sign(wj), abs=0.05)) if wj else abs(g) <= 1.05


def test_draws_are_independent(spark):
    """Row seeds do not collide, and rows agree over the replicates no more than chance has it."""
    from chartloom.functions.hashing import with_row_seeds
    seeds = with_row_seeds(spark.range(200000), F.col("id"))
    assert seeds.select("_row", "_row2").distinct().count() == 200000
    assert seeds.select("_row").distinct().count() < 200000
    drawn = bootstrap.replicate(spark.range(40).withColumn("x", F.lit(1)), "id", 2000)
    table = {}
    for r in drawn.collect():
        table.setdefault(r.id, np.zeros(2000))[r.rep] = r.w
    weights = np.array([table[i] for i in range(40)])
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    joint = np.corrcoef(weights)[np.triu_indices(40, 1)]
    assert np.abs(joint).max() < 0.12


def test_several_key_columns(spark):
    df = make(spark, [(p, a, float(p), float(a)) for p in range(10) for a in range(5)], "p int, a int, t double, y double")
    one = bootstrap.replicate(df, ["p", "a"], 50).groupBy("p", "rep").agg(F.countDistinct("w").alias("n"))
    assert one.agg(F.max("n")).first()[0] > 1
