"""Bootstrap replicates and confidence intervals in one distributed pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chartloom.functions.hashing import PRIME, with_draw, with_row_seeds
from chartloom.operators import curves, metrics
from chartloom.operators.ordered import positions, range_bounds, with_range
from chartloom.operators.replicates import REPLICATES, VECTOR, Rows, combined, draws, poisson_cuts, replicate_sums, scan, seeded, summed

STRETCH = 4096            # positions that meet their draws at once
DRAW_ROWS = 1024          # rows whose draws are held at once
TASK_ROWS = 16384         # rows of a task that draws


def poisson_weight(draw: Column) -> Column:
    return sum(((draw >= cut).cast("int") for cut in poisson_cuts()), F.lit(0))


def replicate(df: DataFrame, row_key: str | list[str], replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(rep, w, columns): every row in every replicate that draws it, with the times it is drawn.

    Poisson(1) weights stand for drawing n rows with replacement; they need no row numbers, no
    join, and all metrics share one set of draws. Rows a replicate does not draw are left out at
    once. Whoever aggregates by `rep` combines within the task first. `row_key` must tell all rows
    apart (several columns may): rows with the same key are drawn together. This is the form for any
    aggregate expression; the intervals below need no such rows (`replicates`).
    """
    # few rows become many: dealt over the shuffle partitions, which are sized to the data, before they are repeated
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = seeded(df, row_key).repartition(partitions, "_row", "_row2").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = with_draw(every, "rep", seed, "_draw").where(F.col("_draw") >= poisson_cuts()[0])
    return drawn.withColumn("w", poisson_weight(F.col("_draw"))).drop("_row", "_row2", "_draw")


def _drawn(seeds: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """(_stretch, draws): every row of `seeds` draws one position of `n` in each replicate. The draws of a block of rows that fall
    into one stretch are one message, a replicate and a place within the stretch for each."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replicate = np.arange(replicates, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, DRAW_ROWS):
                row, row2 = (batch.column(c).slice(start, DRAW_ROWS).to_numpy() for c in ("_row", "_row2"))
                # the same division of doubles as in SQL
                position = ((draws(row, row2, replicates, seed) * n) / PRIME).astype(np.int64)
                stretch = position // STRETCH
                code = (replicate * STRETCH + position - stretch * STRETCH).astype(np.uint32).ravel()
                by = np.argsort(stretch, axis=None, kind="stable")
                stretch, code = stretch.ravel()[by], code[by]
                first = np.flatnonzero(np.diff(stretch, prepend=-1))
                ends = np.append(first, len(stretch))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stretch[first]), pa.array([code[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["_stretch", "draws"])

    return seeds.mapInArrow(draw, "_stretch long, draws binary")


def resample(df: DataFrame, order: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(rep, w, columns): n draws with replacement by position along the unique `order`.

    Moves four bytes per draw, where `replicate` moves none; both are exact. Rows and draws meet by stretches of
    positions: a task holds the draws of one stretch and its rows.
    """
    if replicates * STRETCH > 2**32:
        raise ValueError(f"at most {2**32 // STRETCH} replicates")
    n, spark = df.count(), df.sparkSession
    place = (positions(df, order).drop("position_count").where("position IS NOT NULL")
             .withColumn("_stretch", F.floor(F.col("position") / STRETCH).cast("long")))
    parts = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    seeds = with_row_seeds(spark.range(0, n, 1, parts), F.col("id")).select("_row", "_row2")
    schema = StructType().add("rep", "integer").add("w", "long")
    for field in df.schema:
        schema = schema.add(field)
    arrow, names = to_arrow_schema(schema), df.columns

    def meet(rows: pa.Table, messages: pa.Table) -> pa.Table:
        codes = [np.frombuffer(m.as_buffer(), dtype=np.uint32) for m in messages.column("draws")]
        counts = np.bincount(np.concatenate([np.zeros(0, np.uint32), *codes]), minlength=replicates * STRETCH)
        at = rows.column("position").to_numpy() % STRETCH
        w = counts.reshape(replicates, STRETCH)[:, at]
        rep, row = np.nonzero(w)
        found = rows.select(names).take(pa.array(row))
        return pa.Table.from_arrays([pa.array(rep.astype(np.int32)), pa.array(w[rep, row]), *found.columns], names=schema.names).cast(arrow)

    return place.groupBy("_stretch").cogroup(_drawn(seeds, n, replicates, seed).groupBy("_stretch")).applyInArrow(meet, schema)


def interval(df: DataFrame, keys: list[str], value: str, clamp: bool = False) -> DataFrame:
    """2.5 and 97.5 percent points over the replicates: at most one number per replicate."""
    low, high = F.percentile(value, F.lit(0.025)), F.percentile(value, F.lit(0.975))
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return df.groupBy(*keys).agg(low.alias("lo"), high.alias("hi"), F.count(value).alias("used"))


def bootstrap_metric(df: DataFrame, row_key: str, truth: str, metric: Column, keys: list[str] = (),
                     replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Interval of any weighted aggregate expression over the columns of `df` and `w`. Replicates
    with a single true value are left out."""
    reps = (replicate(df, row_key, replicates, seed).groupBy(*keys, "rep")
            .agg(metric.alias("value"), F.min(truth).alias("_a"), F.max(truth).alias("_b"))
            .where("_a < _b"))
    return interval(reps, list(keys), "value")


def bootstrap_rmse(df: DataFrame, row_key: str | list[str], truth: str, prediction: str, keys: list[str] = (),
                   replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Interval of the RMSE. Replicates with a single true value are left out."""
    squares = F.pow(F.col(truth) - F.col(prediction), 2)
    reps = replicate_sums(df, row_key, {"n": F.lit(1), "squares": squares}, {"truth": F.col(truth)}, keys, replicates, seed)
    usable = reps.where("min_truth < max_truth").withColumn("value", F.sqrt(F.col("squares") / F.col("n")))
    return interval(usable, list(keys), "value")


class Sums:
    """The reader of a range's rows that carry vectors already: sorted values."""

    def __init__(self, table, order: str, descending: bool, replicates: int, seed: int):
        self.table, self.replicates = table, replicates
        self.values = table.column(order).to_numpy().astype(np.float64)
        self.by = np.argsort(self.values, kind="stable")

    def vector(self, name: str, at: int) -> np.ndarray | None:
        found = self.table.column(name)[int(at)].values
        return None if found is None else found.to_numpy()


VECTORS = StructType().add("truth", "double").add("w", VECTOR).add("wp", VECTOR).add("wpp", VECTOR)


def _total(rows: Rows) -> np.ndarray:
    return sum(w.sum(axis=0) for _, w in rows.blocks())


def _rank_predictions(truth: str):
    """Per true value of a range: its weight and the sum of its centred prediction ranks; once per range their squares."""
    def walk(rows: Rows, before: np.ndarray, whole: np.ndarray) -> Iterator[dict]:
        truths, middle, running = rows.column(truth).astype(np.float64), (whole + 1) / 2, before.copy()
        weight: dict[float, np.ndarray] = {}
        ranks: dict[float, np.ndarray] = {}
        squares, tied = np.zeros(rows.replicates), {}

        def settle() -> None:
            nonlocal running, squares
            here = sum(tied.values())
            rank = running + (here + 1) / 2 - middle
            squares += here * rank * rank
            running = running + here
            for value, w in tied.items():
                weight[value] = weight.get(value, 0) + w
                ranks[value] = ranks.get(value, 0) + w * rank
            tied.clear()

        last = None
        for span, w in rows.blocks():
            for i, value in enumerate(rows.values[span]):
                if tied and value != last:
                    settle()
                last, of = value, truths[span.start + i]
                tied[of] = tied[of] + w[i] if of in tied else w[i].copy()
        settle()
        for value in weight:
            yield {"truth": value, "w": weight[value], "wp": ranks[value], "wpp": squares}
            squares = None
    return walk


def _rank_truths(rows: Sums, before: np.ndarray, whole: np.ndarray) -> Iterator[dict]:
    running, middle = before.copy(), (whole + 1) / 2
    spread, product, squares = (np.zeros(rows.replicates) for _ in range(3))
    values = rows.values[rows.by]
    for same in np.split(rows.by, np.flatnonzero(np.diff(values)) + 1):
        w = sum(rows.vector("w", at) for at in same)
        rank = running + (w + 1) / 2 - middle
        spread += w * rank * rank
        product += rank * sum(rows.vector("wp", at) for at in same)
        running = running + w
        for at in same:
            more = rows.vector("wpp", at)
            if more is not None:
                squares += more
    yield {"sums": np.concatenate([spread, product, squares])}


def bootstrap_spearman(df: DataFrame, row_key: str | list[str], truth: str, prediction: str, keys: list[str] = (),
                       replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Interval of the rank correlation.

    One scan over the predictions leaves, per true value and range, the weights and the sums of centred
    ranks in all replicates; one over the true values finishes them. Two vectors travel per true value and range:
    the scale has few values; with as many as rows, more shuffle partitions keep a range's vectors (16 KB a value) small.
    """
    keys = list(keys)
    rows = combined(seeded(df, row_key), [*keys, truth, prediction], replicates, seed)
    rows = with_range(rows, prediction, range_bounds(df, prediction), "_range")
    halves = scan(rows, keys, prediction, _total, _rank_predictions(truth), VECTORS, replicates=replicates, seed=seed)
    halves = with_range(halves, "truth", range_bounds(df, truth), "_range")
    parts = scan(halves, keys, "truth", lambda r: sum(r.vector("w", at) for at in r.by), _rank_truths,
                 StructType().add("sums", VECTOR), replicates=replicates, seed=seed, read=Sums)
    reps = summed(parts, keys, "sums", ["spread", "product", "squares"], replicates)
    both = F.sqrt("spread") * F.sqrt("squares")
    return interval(reps.where(both > 0).withColumn("spearman", F.col("product") / both), keys, "spearman")


def _classes() -> dict[str, tuple[Column, Column]]:
    return {"0": (1 - F.col("y"), F.col("zero")), "1": (F.col("y"), F.col("one"))}


def _scope_values(cells: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Long (keys, scope, metric, value) of all eight metrics for 0, 1, macro and micro, from the counts
    a_tp, ..., t_tn and the areas auroc_0, ..., auprc_micro.

    Macro and micro use the label with the larger probability, the single labels the tuned one;
    the areas use the probabilities. The `macro` AUPRC is the stacked one: the same as micro.
    """
    by_argmax = metrics.binary_metrics(*[F.col(f"a_{c}") for c in CELLS])
    by_tuned = metrics.binary_metrics(*[F.col(f"t_{c}") for c in CELLS])
    hard = cells.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
        for scope, table in (("0", by_tuned), ("1", by_tuned), ("macro", by_argmax), ("micro", by_argmax))
        for m, v in table[scope].items()])))

    def mean(area):
        return (F.col(f"{area}_0") + F.col(f"{area}_1")) / 2
    soft_values = [(s, name, F.col(f"{a}_{s}")) for s in ("0", "1", "micro")
                   for name, a in (("AUROC", "auroc"), ("AP", "ap"), ("AUPRC", "auprc"))]
    soft_values += [("macro", "AUROC", mean("auroc")), ("macro", "AP", mean("ap")),
                    ("macro", "AUPRC", F.col("auprc_micro"))]
    soft = areas.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("scope"), F.lit(m).alias("metric"), v.alias("value")) for s, m, v in soft_values])))
    return hard.unionByName(soft)


CELLS = ("tp", "fp", "fn", "tn")
AREAS = ("auroc", "ap", "auprc")


def _prepared(df: DataFrame) -> tuple[DataFrame, list[float]]:
    ready = df.withColumn("argmax", (F.col("one") > F.col("zero")).cast("int"))
    both = ready.select(F.explode(F.array("zero", "one")).alias("score"))
    return ready, range_bounds(both, "score")


def binary_report(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """All metrics of `y`, `zero`, `one`, `y_hard` per scope."""
    keys = list(keys)
    ready, bounds = _prepared(df)
    cells = ready.groupBy(*keys).agg(*metrics.count_cells(ready, keys, "y", "argmax", None, "a_"),
                                     *metrics.count_cells(ready, keys, "y", "y_hard", None, "t_"))
    areas = curves.curve_areas(curves.stacked(ready, _classes(), keys), [*keys, "scope"], "truth", "score", None, bounds)
    wide = areas.groupBy(*keys).agg(*[F.max(F.when(F.col("scope") == s, F.col(a))).alias(f"{a}_{s}") for s in ("0", "1", "micro") for a in AREAS])
    return _scope_values(cells, wide, keys)


SCOPES = {"0": [0], "1": [1], "micro": [0, 1]}
STRETCHES = [f"{name}_{s}" for s in SCOPES for name in ("roc", "step", "strip", "pos", "neg")]


def _sides(rows: Rows) -> np.ndarray:
    """Which of class 0 negatives, class 0 positives, class 1 negatives, class 1 positives a row is."""
    return (rows.column("class") * 2 + rows.column("truth")).astype(np.int64)


def _side_totals(rows: Rows) -> np.ndarray:
    sides, out = _sides(rows), np.zeros((4, rows.replicates))
    for span, w in rows.blocks():
        for side in range(4):
            out[side] += w[sides[span] == side].sum(axis=0)
    return out.ravel()


def _strips(rows: Rows, before: np.ndarray, whole: np.ndarray) -> Iterator[dict]:
    """Walking down the scores: each score's strips under the curves of both classes and of their stack."""
    sides, n = _sides(rows), rows.replicates
    above = before.reshape(4, n).copy()
    out, here = np.zeros((3, 5, n)), np.zeros((4, n))

    def by_scope(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        neg, pos = counts[0::2], counts[1::2]
        return np.vstack([neg, neg.sum(axis=0)]), np.vstack([pos, pos.sum(axis=0)])

    def settle() -> None:
        (neg, pos), (neg_above, pos_above) = by_scope(here), by_scope(above)
        earlier, now = neg_above + pos_above, neg_above + pos_above + neg + pos
        precision = np.divide(pos_above + pos, now, out=np.zeros_like(now), where=now > 0)
        up_to = np.divide(pos_above, earlier, out=np.ones_like(now), where=earlier > 0)
        out[:, 0] += neg * (pos_above + pos / 2)
        out[:, 1] += pos * precision
        out[:, 2] += pos * (precision + up_to) / 2
        out[:, 3] += pos
        out[:, 4] += neg
        above[:] += here
        here[:] = 0

    last = None
    for span, w in rows.blocks():
        for i, value in enumerate(rows.values[span]):
            if last is not None and value != last:
                settle()
            last = value
            here[sides[span.start + i]] += w[i]
    settle()
    yield {"sums": out.ravel()}


def bootstrap_binary(df: DataFrame, row_key: str | list[str], keys: list[str] = (), replicates: int = REPLICATES,
                     seed: int = 1) -> DataFrame:
    """Intervals of all metrics and scopes from one shared set of replicates. Replicates with a
    single true class are left out; bounds are clamped to [0, 1]."""
    keys = list(keys)
    ready, bounds = _prepared(df)
    counts = {f"{prefix}_{c}": ((F.col("y") == t) & (F.col(label) == p)).cast("double") for prefix, label in (("a", "argmax"), ("t", "y_hard"))
              for c, (t, p) in zip(CELLS, ((1, 1), (0, 1), (1, 0), (0, 0)))}
    cells = replicate_sums(ready, row_key, counts, {"y": F.col("y")}, keys, replicates, seed)

    each = seeded(ready, row_key).select(*keys, "_row", "_row2", F.inline(F.array(*[
        F.struct(F.lit(int(name)).alias("class"), truth.cast("int").alias("truth"), score.cast("double").alias("score"))
        for name, (truth, score) in _classes().items()])))
    rows = with_range(combined(each, [*keys, "class", "truth", "score"], replicates, seed), "score", bounds, "_range")
    parts = scan(rows, keys, "score", _side_totals, _strips, StructType().add("sums", VECTOR),
                 descending=True, replicates=replicates, seed=seed)
    sums = summed(parts, keys, "sums", STRETCHES, replicates)

    def share(top: str, bottom: Column) -> Column:
        return F.when(bottom > 0, F.col(top) / bottom)
    areas = sums.select(*keys, "rep", *[c for s in SCOPES for c in (
        share(f"roc_{s}", F.col(f"pos_{s}") * F.col(f"neg_{s}")).alias(f"auroc_{s}"),
        share(f"step_{s}", F.col(f"pos_{s}")).alias(f"ap_{s}"), share(f"strip_{s}", F.col(f"pos_{s}")).alias(f"auprc_{s}"))])
    # a replicate without both classes has no AUROC; one row per key and replicate on either side
    usable = cells.where("min_y < max_y").select(*keys, "rep")
    values = _scope_values(cells, areas, [*keys, "rep"]).join(usable, [*keys, "rep"], "left_semi")
    return interval(values, [*keys, "scope", "metric"], "value", clamp=True)


def perf(df: DataFrame, row_key: str, keys: list[str] = (), replicates: int = REPLICATES) -> DataFrame:
    """The full report: value, interval and its printed form per scope and metric."""
    points = binary_report(df, keys)
    ranges = bootstrap_binary(df, row_key, keys, replicates)
    return points.join(ranges, [*keys, "scope", "metric"]).withColumn(
        "ci", F.format_string(" [%s-%s]", F.round("lo", 2).cast("string"), F.round("hi", 2).cast("string")))
