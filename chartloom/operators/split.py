"""Train/test split and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.functions.hashing import hash32
from chartloom.operators.ordered import ordered_scan, positions


def split_label(entity: Column, train_tenths: int = 7) -> Column:
    """`train` or `test`, decided by the entity alone: all its rows land on one side, wherever
    and whenever the plan runs, and nothing is shuffled."""
    return F.when(hash32(entity) % 10 < train_tenths, "train").otherwise("test")


def with_split(df: DataFrame, entity: str, train_tenths: int = 7) -> DataFrame:
    return df.withColumn("split", split_label(F.col(entity), train_tenths))


def contiguous_folds(df: DataFrame, order: str, folds: int = 5) -> DataFrame:
    """Unshuffled k-fold: blocks along `order`; the first n % k blocks are one row longer."""
    placed = positions(df, order)
    n, at = F.col("position_count"), F.col("position")
    base = (n / folds).cast("long")
    longer = n % folds
    cut = longer * (base + 1)
    fold = F.when(at < cut, (at / (base + 1)).cast("long")) \
        .otherwise(longer + ((at - cut) / F.greatest(base, F.lit(1))).cast("long"))
    return placed.withColumn("fold", fold.cast("int")).drop("position", "position_count")


def stratified_folds(df: DataFrame, order: str, label: str, folds: int = 5) -> DataFrame:
    """Unshuffled stratified k-fold: within each class the folds are blocks along `order`. How many
    rows of a class a fold takes follows from dealing the rows, sorted by class, out in turn;
    classes count in the order in which they first occur."""
    counted = df.withColumn("_one", F.lit(1))
    placed = ordered_scan(counted, [label], order, sums=["_one"])
    # one row per class
    sizes = (counted.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(
                 Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    joined = placed.join(F.broadcast(sizes), label)  # one row per class
    at = F.col("cum__one") - 1
    start, end = F.col("_before"), F.col("_before") + F.col("_n")

    def dealt(limit: Column, fold: int) -> Column:
        # how many of 0 .. limit - 1 leave the remainder `fold`
        return ((limit + (folds - 1 - fold)) / folds).cast("long")

    upto, fold = F.lit(0), F.lit(None).cast("int")
    ends = []
    for k in range(folds):
        upto = upto + dealt(end, k) - dealt(start, k)
        ends.append((k, upto))
    chosen = F.coalesce(*[F.when(at < until, k) for k, until in ends], fold)
    return joined.withColumn("fold", chosen.cast("int")).drop("_one", "cum__one", "all__one", "_n", "_first", "_before")
