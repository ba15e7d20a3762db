"""Scalar metrics as aggregate expressions, with integer row weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.operators.ordered import range_bounds, with_average_rank


def rmse_of(truth: Column, prediction: Column, weight: Column | None = None) -> Column:
    w = F.lit(1) if weight is None else weight
    return F.sqrt(F.sum(w * F.pow(truth - prediction, 2)) / F.sum(w))


def spearman(df: DataFrame, keys: list[str], truth: str, prediction: str, weight: str | None = None,
             bounds: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Rank correlation with averaged ties per key; NaN where one side is constant.

    Equal pairs are counted first. One scan ranks the predictions; per true value what their centred ranks
    sum to is all that the scan over the true values needs, so a scale of seven values is as good as any.
    """
    w = F.col(weight) if weight else F.lit(1)
    pairs = df.groupBy(*keys, truth, prediction).agg(F.sum(w).alias("w")).where("w > 0")
    bounds_t, bounds_p = bounds or (range_bounds(df, truth), range_bounds(df, prediction))
    ranked = with_average_rank(pairs, keys, prediction, "w", "_p", bounds_p)
    # centred on the known mean: sums of squares stay small for any number of rows
    p = F.col("_p") - (F.col("_p_all") + 1) / 2.0
    per_truth = ranked.groupBy(*keys, truth).agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * p).alias("_wp"), F.sum(F.col("w") * p * p).alias("_wpp"))
    per_truth = with_average_rank(per_truth, keys, truth, "w", "_t", bounds_t)
    t = F.col("_t") - (F.col("_t_all") + 1) / 2.0
    spread = F.sqrt(F.sum(F.col("w") * t * t)) * F.sqrt(F.sum("_wpp"))
    return per_truth.groupBy(*keys).agg(F.when(spread > 0, F.sum(F.col("_wp") * t) / spread).otherwise(F.lit(float("nan"))).alias("spearman"))


def count_cells(df: DataFrame, keys: list[str], truth: str, predicted: str, weight: str | None = None,
                prefix: str = "") -> list[Column]:
    w = F.col(weight) if weight else F.lit(1)

    def cell(t, p):
        return F.sum(F.when((F.col(truth) == t) & (F.col(predicted) == p), w).otherwise(0))
    return [cell(1, 1).alias(f"{prefix}tp"), cell(0, 1).alias(f"{prefix}fp"),
            cell(1, 0).alias(f"{prefix}fn"), cell(0, 0).alias(f"{prefix}tn")]


def ratio(num: Column, den: Column) -> Column:
    """0 where there is nothing to divide by, as the usual reports print it."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def label_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Of one class seen as positive."""
    return {"ACC": (tp + tn) / (tp + fp + fn + tn), "Recall": ratio(tp, tp + fn), "Spec": ratio(tn, tn + fp),
            "F1": ratio(2.0 * tp, 2 * tp + fp + fn), "PPV": ratio(tp, tp + fp)}


def binary_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, dict[str, Column]]:
    """Hard-label metrics for the scopes `1`, `0`, `macro` and `micro` of a two-class problem.

    Over one-hot pairs the micro averages all equal the accuracy, micro specificity included.
    """
    one = label_metrics(tp, fp, fn, tn)
    zero = label_metrics(tn, fn, fp, tp)
    macro = {m: (one[m] + zero[m]) / 2 for m in one}
    macro["ACC"] = one["ACC"]
    return {"1": one, "0": zero, "macro": macro, "micro": {m: one["ACC"] for m in one}}


def confusion(df: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Counts on the full grid of classes, and the shares by true and by predicted class."""
    stray = F.raise_error(F.concat(F.lit("label outside the classes: "), F.col(truth).cast("string"), F.lit(" / "),
                                   F.coalesce(F.col(predicted).cast("string"), F.lit("null"))))
    listed = F.col(truth).isin(classes) & F.col(predicted).isin(classes)
    # classes x classes rows at most: any other label ends the query
    counted = (df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("n", F.when(listed, F.col("n")).otherwise(stray.cast("long"))))
    values = F.array(*[F.lit(k) for k in classes])
    spark = df.sparkSession
    grid = (spark.range(1).select(F.explode(values).alias(truth))
            .select(truth, F.explode(values).alias(predicted)))
    # classes x classes rows from here on
    full = grid.join(F.broadcast(counted), [truth, predicted], "left").na.fill(0, subset=["n"])
    by_truth = F.sum("n").over(Window.partitionBy(truth))
    by_predicted = F.sum("n").over(Window.partitionBy(predicted))
    return full.select(truth, predicted, "n", ratio(F.col("n"), by_truth).alias("of_true"),
                       ratio(F.col("n"), by_predicted).alias("of_predicted"))
