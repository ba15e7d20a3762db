"""ROC and precision-recall curves and their areas, per key, with integer row weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chartloom.operators.ordered import ordered_scan, range_bounds


def score_totals(df: DataFrame, keys: list[str], truth: str, score: str, weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score. Doing this first settles ties and leaves one
    row per score, however many rows share it."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(truth) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(truth) == 1, 0).otherwise(w)).alias("neg"))


def threshold_table(df: DataFrame, keys: list[str], truth: str, score: str, weight: str | None = None,
                    bounds: list[float] | None = None, leads: list[str] = ()) -> DataFrame:
    """Counts at and above every distinct score, walking down the scores."""
    return ordered_scan(score_totals(df, keys, truth, score, weight), keys, score, descending=True,
                        sums=["pos", "neg"], leads=list(leads), bounds=bounds)


def _tpr() -> Column:
    return F.col("cum_pos") / F.col("all_pos")


def _precision() -> Column:
    return F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))


def roc_points(df: DataFrame, keys: list[str], truth: str, score: str,
               drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) per key, with the origin as a point without threshold. Points whose
    step equals the step to their successor lie on a straight line and are left out."""
    table = threshold_table(df, keys, truth, score, leads=["pos", "neg"])
    if drop_intermediate:
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        last = F.col("next_pos").isNull()
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        table = table.where(first | last | bend)
    points = table.select(*keys, F.col(score).alias("threshold"),
                          (F.col("cum_neg") / F.col("all_neg")).alias("fpr"), _tpr().alias("tpr"))
    origin = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    return points.unionByName(origin.select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def pr_points(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """(threshold, precision, recall, f1) per key and distinct score; f1 is 0 where it is 0/0."""
    table = threshold_table(df, keys, truth, score)
    f1 = 2 * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg") + F.col("all_pos"))
    return table.select(*keys, F.col(score).alias("threshold"), _precision().alias("precision"),
                        _tpr().alias("recall"), f1.alias("f1"))


def f1_threshold(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Threshold with the best F1; among equals the lowest."""
    points = pr_points(df, keys, truth, score)
    best = F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))
    return points.groupBy(*keys).agg(best.alias("threshold"), F.max("f1").alias("f1"))


def curve_areas(df: DataFrame, keys: list[str], truth: str, score: str, weight: str | None = None,
                bounds: list[float] | None = None) -> DataFrame:
    """AUROC, average precision and area under the precision-recall curve per key, in one pass.

    Each score's strip follows from its own counts and the running totals: the trapezoid under
    the ROC curve, the step of average precision, and the trapezoid under the PR curve, which
    starts at recall 0 with precision 1.
    """
    table = threshold_table(df, keys, truth, score, weight, bounds)
    before_pos = F.col("cum_pos") - F.col("pos")
    before_all = before_pos + F.col("cum_neg") - F.col("neg")
    roc = F.col("neg") * (before_pos + F.col("pos") / 2.0)
    earlier = F.when(before_all == 0, 1.0).otherwise(before_pos / before_all)
    step = F.col("pos") * _precision()
    strip = F.col("pos") * (_precision() + earlier) / 2.0
    positives, negatives = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    both = positives * negatives
    return table.groupBy(*keys).agg(
        F.when(both > 0, F.sum(roc) / both).alias("auroc"),
        F.when(positives > 0, F.sum(step) / positives).alias("ap"),
        F.when(positives > 0, F.sum(strip) / positives).alias("auprc"))


def stacked(df: DataFrame, classes: dict[str, tuple[Column, Column]], keep: list[str]) -> DataFrame:
    """One-vs-rest rows (scope, truth, score): one per class, and once more under `micro`, where
    the classes are looked at as one long list."""
    rows = F.array(*[
        F.struct(F.lit(scope).alias("scope"), truth.cast("int").alias("truth"), score.cast("double").alias("score"))
        for name, (truth, score) in classes.items() for scope in (name, "micro")])
    return df.select(*keep, F.inline(rows))


def macro_roc(points: DataFrame, scope: str, scopes: list[str]) -> DataFrame:
    """Mean of the curves of all scopes on the union of their false-positive rates.

    On a rate where a curve rises straight up its upper end counts; between two of its rates a
    curve is a straight line to the lower end of the next rise.
    """
    ends = points.groupBy(scope, "fpr").agg(F.max("tpr").alias("high"), F.min("tpr").alias("low"))
    grid = points.select("fpr").distinct().select(
        "fpr", F.explode(F.array(*[F.lit(s) for s in scopes])).alias(scope))
    placed = grid.join(ends, [scope, "fpr"], "left").withColumns({
        "start": F.when(F.col("high").isNotNull(), F.struct("fpr", "high")),
        "stop": F.when(F.col("low").isNotNull(), F.struct("fpr", "low")),
    })
    bounds = range_bounds(points, "fpr")
    scan = ordered_scan(placed, [scope], "fpr", down=["start"], up=["stop"], bounds=bounds)
    along = (F.col("fpr") - F.col("prev_start.fpr")) / (F.col("foll_stop.fpr") - F.col("prev_start.fpr"))
    line = F.col("prev_start.high") + (F.col("foll_stop.low") - F.col("prev_start.high")) * along
    return (scan.withColumn("value", F.coalesce("high", line))
            .groupBy("fpr").agg((F.sum("value") / len(scopes)).alias("tpr")))


def trapezoid_area(curve: DataFrame, x: str = "fpr", y: str = "tpr") -> DataFrame:
    scan = ordered_scan(curve, [], x, leads=[x, y])
    return scan.agg(F.sum((F.col(f"next_{x}") - F.col(x)) * (F.col(f"next_{y}") + F.col(y)) / 2).alias("auc"))
