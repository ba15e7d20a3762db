"""Running totals, ranks, neighbours and quantiles over one global order, without one big task.

A window with no partition key would sort everything in a single task. Here the order column is
cut into value ranges at approximate quantiles; each range is scanned on its own, and a table
with one row per key and range carries totals and edge values across the cuts.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from chartloom.sources.checkpoints import materialise


def range_bounds(df: DataFrame, order: str) -> list[float]:
    """Cut points from Spark's quantile sketch: as many ranges as the session has shuffle partitions,
    which is what one sizes to the data. One number per range reaches the driver."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return []
    values = df.select(F.col(order).cast("double").alias("v"))
    return sorted(set(values.approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.5 / ranges)))


def with_range(df: DataFrame, order: str, bounds: list[float], out: str) -> DataFrame:
    """Add the index of the value's range, by binary search; a bound belongs to the range above it."""
    splits = [-float("inf"), *(b + 0.0 for b in bounds), float("inf")]
    cut = Bucketizer(splits=splits if bounds else [-float("inf"), 0.0, float("inf")], inputCol="_at", outputCol="_bucket",
                     handleInvalid="keep")
    ranged = cut.transform(df.withColumn("_at", F.col(order).cast("double")))
    return ranged.withColumn(out, F.col("_bucket").cast("int")).drop("_at", "_bucket")


def ordered_scan(df: DataFrame, keys: list[str], order: str, *, descending: bool = False,
                 sums: list[str] = (), leads: list[str] = (), down: list[str] = (), up: list[str] = (),
                 bounds: list[float] | None = None) -> DataFrame:
    """Add per key, along `order` (unique within a key):

    - `cum_<c>` and `all_<c>` for each of `sums`: total up to and including the row, and overall
    - `next_<c>` for each of `leads`: the following row's (non-null) value
    - `prev_<c>` for each of `down`: last non-null value at or before the row
    - `foll_<c>` for each of `up`: first non-null value at or after the row

    `bounds` (see `range_bounds`) may come from a smaller table with the same values.
    """
    if bounds is None:
        bounds = range_bounds(df, order)
    ranged = with_range(df, order, bounds, "_range")
    if descending:
        ranged = ranged.withColumn("_range", -F.col("_range"))

    by = F.col(order).desc() if descending else F.col(order).asc()
    part = Window.partitionBy(*keys, "_range")
    here = part.orderBy(by)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = here.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scanned = ranged.withColumns({
        **{f"cum_{c}": F.sum(c).over(so_far) for c in sums},
        **{f"next_{c}": F.lead(c).over(here) for c in leads},
        **{f"prev_{c}": F.last(c, ignorenulls=True).over(so_far) for c in down},
        **{f"foll_{c}": F.first(c, ignorenulls=True).over(from_here) for c in up},
    })
    first_by, last_by = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)

    def known(c):
        return F.when(F.col(c).isNotNull(), F.col(order))

    edges = ranged.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_s_{c}") for c in sums],
        *[first_by(c, order).alias(f"_n_{c}") for c in leads],
        *[last_by(F.col(c), known(c)).alias(f"_d_{c}") for c in down],
        *[first_by(F.col(c), known(c)).alias(f"_u_{c}") for c in up])
    # one row per key and range: as many rows in a partition of these windows as there are ranges
    across = Window.partitionBy(*keys).orderBy("_range")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    overall = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = edges.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_cs_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(overall).alias(f"all_{c}") for c in sums],
        *[F.lead(f"_n_{c}").over(across).alias(f"_cn_{c}") for c in leads],
        *[F.last(f"_d_{c}", ignorenulls=True).over(before).alias(f"_cd_{c}") for c in down],
        *[F.first(f"_u_{c}", ignorenulls=True).over(after).alias(f"_cu_{c}") for c in up])
    if not keys:
        carried = F.broadcast(carried)  # one row per range

    joined = scanned.join(carried, [*keys, "_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_cs_{c}") + F.col(f"cum_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"all_{c}") for c in sums],
        *[F.coalesce(f"next_{c}", f"_cn_{c}").alias(f"next_{c}") for c in leads],
        *[F.coalesce(f"prev_{c}", f"_cd_{c}").alias(f"prev_{c}") for c in down],
        *[F.coalesce(f"foll_{c}", f"_cu_{c}").alias(f"foll_{c}") for c in up])


def positions(df: DataFrame, order: str, keys: list[str] = (), out: str = "position") -> DataFrame:
    """0-based row number along a unique numeric `order`, and the number of rows as `<out>_count`."""
    scan = ordered_scan(df.withColumn("_each", F.lit(1)), list(keys), order, sums=["_each"])
    return (scan.withColumn(out, F.col("cum__each") - 1)
            .withColumnRenamed("all__each", f"{out}_count").drop("_each", "cum__each"))


def with_average_rank(df: DataFrame, keys: list[str], value: str, weight: str, out: str,
                      bounds: list[float] | None = None) -> DataFrame:
    """Add the rank of `value` per key with ties averaged, each row counting `weight` times, and the key's
    total weight as `<out>_all`. The rank is carried on by the rows themselves: nothing is joined on values."""
    if bounds is None:
        bounds = range_bounds(df, value)
    ranged = with_range(df, value, bounds, "_range")
    # both windows live in one partitioning and one sort
    part = Window.partitionBy(*keys, "_range").orderBy(value)
    until = F.sum(weight).over(part.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum(weight).over(Window.partitionBy(*keys, "_range", value))
    inside = ranged.withColumns({"_until": until, "_tied": tied})
    across = Window.partitionBy(*keys).orderBy("_range")          # one row per key and range
    carried = ranged.groupBy(*keys, "_range").agg(F.sum(weight).alias("_sum")).select(
        *keys, "_range", F.coalesce(F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{out}_all"))
    if not keys:
        carried = F.broadcast(carried)
    rank = F.col("_before") + F.col("_until") - F.col("_tied") + (F.col("_tied") + 1) / 2.0
    return inside.join(carried, [*keys, "_range"]).select(*df.columns, rank.alias(out), f"{out}_all")


# the sketch is right to a rank of rows / SKETCH; a bracket reaches four times as far to either side
SKETCH = 2000
REACH = 4 / SKETCH


def _bracketed(rows: DataFrame, keys: list[str], value: str, wanted: list[float]) -> DataFrame:
    """Per key, the values near the wanted quantiles and what lies between them, as entries (`_lo`, `_hi`, `_n`):
    a value inside a bracket with its count, or everything between two brackets as one entry from its smallest
    to its largest value. Brackets come from a mergeable sketch; the entries from one aggregate over all rows."""
    marks = [max(0.0, min(1.0, p + side)) for p in wanted for side in (-REACH, REACH)]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx(value, marks, SKETCH).alias("_marks"),
                                     F.min(value).alias("_min"), F.max(value).alias("_max"))
    brackets = sketch.select(*keys, *[
        c for i, p in enumerate(wanted) for c in (
            (F.col("_min") if p <= REACH else F.col("_marks")[2 * i]).alias(f"_low{i}"),
            (F.col("_max") if p >= 1 - REACH else F.col("_marks")[2 * i + 1]).alias(f"_high{i}"))])
    at = F.col(value)
    inside, gap = F.lit(False), F.lit(0)
    for i in range(len(wanted)):
        inside = inside | at.between(F.col(f"_low{i}"), F.col(f"_high{i}"))
        gap = gap + F.when(at > F.col(f"_high{i}"), 1).otherwise(0)
    placed = rows.join(brackets, keys).select(*keys, value, gap.alias("_gap"), F.when(inside, at).alias("_own"))
    return placed.groupBy(*keys, "_gap", "_own").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n")).drop("_gap", "_own")


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per named probability. Nulls are skipped; rows with a
    null key drop out.

    Selection, not a sort: only the values inside the sketch's brackets, a few per cent of the rows, are put in
    order, equal ones counted first. The bracket of a probability and the two entries next to it hold the
    position asked for; should a sketch ever be worse than it promises, the query fails and does not guess.
    """
    group = list(keys) or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*keys, value) if keys else (
        df.where(F.col(value).isNotNull()).select(F.lit(0).alias("_all"), value))
    entries = materialise(_bracketed(rows, group, value, sorted(set(probabilities.values()))))
    scan = ordered_scan(entries, group, "_lo", sums=["_n"], leads=["_lo"])

    def share(p):
        # 0-based target position; it falls on an entry or between it and the next
        target = (F.col("all__n") - 1) * F.lit(p)
        last = F.col("cum__n") - 1
        first = F.col("cum__n") - F.col("_n")
        lost = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        on = F.when((target >= first) & (target <= last), F.when((F.col("_lo") == F.col("_hi")) | (target == first), F.col("_lo"))
                    .when(target == last, F.col("_hi")).otherwise(lost))
        between = F.when((target > last) & (target < last + 1),
                         F.col("_hi") + (F.col("next__lo") - F.col("_hi")) * (target - last))
        return F.max(F.coalesce(on, between))

    return scan.groupBy(*group).agg(*[share(p).alias(name) for name, p in probabilities.items()]).select(*keys, *probabilities)
