"""L1 logistic fits of many settings at once: one pass over the rows is one Newton step of all of them.

A pass leaves, per setting, the loss, the gradient and the second derivatives over the features that can move, as
sums of the tasks. Where a setting's sums meet, coordinate descent solves the quadratic model with the penalty; the next pass
tries its solution and halves the step if the objective did not fall. Only weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

CHUNK = 2048              # rows that are expanded at a time
MAX_STEPS = 200
EXACT = 1e-4              # how far an optimality condition may be missed, as a share of the penalty
NEAR = 0.7                # features whose gradient reaches this share of the penalty may move in the next step
FALL = 1e-4               # share of the promised fall of the objective that a step must bring
NOISE = 1e-13             # share of the objective by which its sums may be off
SWEEPS = 3                # turns of all coordinates between two joint moves
RIDGE = 1e-9              # added share of each width in a joint move


@dataclass
class Setting:
    """A penalty and the fold that is left out, and how far its fit has come."""

    penalty: float
    fold: int
    base: np.ndarray = None
    towards: np.ndarray = None
    step: float = 1.0
    value: float = np.inf         # objective at `base`
    promised: float = 0.0
    movable: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.base + self.step * self.towards


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Features, classes as -1 or 1, folds, and the weights for each fold left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            weights = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
            yield x, 2 * part.column(1).to_numpy(zero_copy_only=False) - 1, part.column(2).to_numpy(zero_copy_only=False), np.nan_to_num(weights)


def _rows(df: DataFrame) -> DataFrame:
    rows = df.select(vector_to_array("features_m").alias("x"), F.col("label_m").cast("double").alias("y"), "fold", "weights")
    # sums of a task are as large as the settings' second derivatives: as many tasks as run at a time
    return rows.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def _halved(curves: np.ndarray) -> np.ndarray:
    """The upper triangle, in single precision: it only steers steps, whose end is tested by the gradient."""
    return curves[np.triu_indices(len(curves))].astype(np.float32)


def _whole(half: np.ndarray, size: int) -> np.ndarray:
    curves = np.zeros((size, size))
    curves[np.triu_indices(size)] = half
    return np.triu(curves) + np.triu(curves, 1).T


def _sums(df: DataFrame, settings: dict[int, Setting], size: int) -> DataFrame:
    """(setting, sums, curves): weight, loss and gradient, and second derivatives, of a task's rows at the setting's trial."""
    known = df.sparkSession.sparkContext.broadcast({k: (s.trial(), s.fold, s.movable) for k, s in settings.items()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried = known.value
        weights = np.array([t for t, _, _ in tried.values()]).T
        sums = {k: np.zeros(2 + size) for k in tried}
        curves = {k: np.zeros((len(m), len(m))) for k, (_, _, m) in tried.items()}
        for x, sign, fold, w in _chunks(batches, size):
            margins = sign[:, None] * (x @ weights)
            for i, (k, (_, out, movable)) in enumerate(tried.items()):
                inside = np.flatnonzero((fold != out) & (w[:, out] > 0))
                own, margin = w[inside, out], margins[inside, i]
                wrong = np.exp(-np.logaddexp(0, margin))          # probability of the other class
                pull = np.zeros(len(x))
                pull[inside] = -own * sign[inside] * wrong
                sums[k] += np.concatenate([[own.sum(), own @ np.logaddexp(0, -margin)], pull @ x])
                near = x[np.ix_(inside, movable)] * np.sqrt(own * wrong * (1 - wrong))[:, None]
                curves[k] += near.T @ near                        # of one table with itself: half the products
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()),
             pa.array([_halved(c).tobytes() for c in curves.values()], pa.binary())], names=["setting", "sums", "curves"])
    return _rows(df).mapInArrow(add, "setting int, sums binary, curves binary")


def _sweep(w: np.ndarray, slope: np.ndarray, curves: np.ndarray, penalty: float) -> None:
    """A turn for every coordinate, in place: the minimum along it."""
    widths = np.diag(curves)
    for j in np.flatnonzero(widths > 0):
        free = w[j] * widths[j] - slope[j]
        moved = np.sign(free) * max(abs(free) - penalty, 0.0) / widths[j] - w[j]
        if moved:
            w[j] += moved
            slope += moved * curves[j]


def _slack(w: np.ndarray, slope: np.ndarray, penalty: float) -> np.ndarray:
    """By how much each coordinate's optimality condition is missed."""
    return np.where(w != 0, np.abs(slope + penalty * np.sign(w)), np.maximum(np.abs(slope) - penalty, 0))


def descend(gradient: np.ndarray, curves: np.ndarray, start: np.ndarray, penalty: float, rounds: int = 100) -> np.ndarray:
    """Minimum over w of gradient (w - start) + (w - start) curves (w - start) / 2 + penalty |w|.

    Sweeps over the coordinates find which of them move; the ones that are not zero then go together to the minimum for
    their signs, as far as the first sign change: that one stops at zero and the others go on.
    """
    w, slope, usable = start.copy(), gradient.copy(), np.diag(curves) > 0
    for _ in range(rounds):
        for _ in range(SWEEPS):
            _sweep(w, slope, curves, penalty)
        while len(held := np.flatnonzero((w != 0) & usable)):
            inner = curves[np.ix_(held, held)]
            inner[np.diag_indices(len(held))] *= 1 + RIDGE        # equal features have no single minimum
            move = np.linalg.solve(inner, -(slope[held] + penalty * np.sign(w[held])))
            turn = w[held] * (w[held] + move) < 0
            share = np.where(turn, -w[held] / np.where(turn, move, 1.0), 1.0)
            first = share.min()
            w[held] += first * move
            w[held[turn & (share == first)]] = 0.0
            slope = gradient + curves @ (w - start)
            if first == 1.0:
                break
        if _slack(w, slope, penalty)[usable].max(initial=0.0) <= penalty * EXACT / 10:
            break
    return w


def _advance(s: Setting, total: np.ndarray, half: np.ndarray, size: int) -> Setting:
    """Take or halve the step tried; if taken, aim at the next or end."""
    weight, here = total[0], s.trial()
    value = total[1] / weight + s.penalty * np.abs(here).sum()
    if value > s.value + FALL * s.step * s.promised + NOISE * abs(s.value) and s.step > 1e-9:
        return Setting(s.penalty, s.fold, s.base, s.towards, s.step / 2, s.value, s.promised, s.movable)
    gradient = total[2:] / weight
    if _slack(here, gradient, s.penalty).max() <= EXACT * s.penalty or s.step <= 1e-9:
        return Setting(s.penalty, s.fold, here, np.zeros(size), value=value, done=True)
    goal = here.copy()
    if len(s.movable):
        curves = _whole(half, len(s.movable)) / weight
        goal[s.movable] = descend(gradient[s.movable], curves, here[s.movable], s.penalty)
    promised = gradient @ (goal - here) + s.penalty * (np.abs(goal).sum() - np.abs(here).sum())
    movable = np.flatnonzero((goal != 0) | (here != 0) | (np.abs(gradient) >= NEAR * s.penalty))
    return Setting(s.penalty, s.fold, here, goal - here, 1.0, value, promised, movable)


STATE = ("setting int, base array<double>, towards array<double>, step double, value double, promised double, "
         "movable array<long>, done boolean")


def fit_settings(rows: DataFrame, settings: list[tuple[float, int]]) -> list[np.ndarray]:
    """The weights for each (penalty, fold left out). `rows` is a stored table (features_m, label_m, fold, weights)."""
    first = rows.select(F.size(vector_to_array("features_m")).alias("n")).first()
    size = first["n"] if first else 0
    fits = {k: Setting(float(penalty), fold, np.zeros(size), np.zeros(size)) for k, (penalty, fold) in enumerate(settings)}
    for _ in range(MAX_STEPS):
        going = {k: s for k, s in fits.items() if not s.done}
        if not going or not size:
            break
        known = rows.sparkSession.sparkContext.broadcast(going)

        def advance(part: pd.DataFrame) -> pd.DataFrame:
            k = int(part["setting"].iloc[0])
            half = sum(np.frombuffer(b, np.float32).astype(float) for b in part["curves"])
            s = _advance(known.value[k], sum(np.frombuffer(b) for b in part["sums"]), half, size)
            return pd.DataFrame([(k, s.base, s.towards, s.step, s.value, s.promised, s.movable, s.done)],
                                columns=["setting", "base", "towards", "step", "value", "promised", "movable", "done"])
        # a number of partitions by name is kept: the settings of a small table are solved side by side too
        sums = _sums(rows, going, size).repartition(max(len(going) // 2, 1), "setting")
        # one row of weights per setting
        for r in sums.groupBy("setting").applyInPandas(advance, STATE).collect():
            s = fits[r["setting"]]
            fits[r["setting"]] = Setting(s.penalty, s.fold, np.array(r["base"]), np.array(r["towards"]), r["step"], r["value"],
                                         r["promised"], np.array(r["movable"], np.int64), r["done"])
    else:
        raise RuntimeError(f"{sum(not s.done for s in fits.values())} fits did not end in {MAX_STEPS} steps")
    return [s.base for s in fits.values()]


def held_out_right(rows: DataFrame, settings: list[tuple[float, int]], weights: list[np.ndarray]) -> list[int]:
    """For each setting the rows of its fold whose class has the larger probability; class 0 where they are equal."""
    size = len(weights[0])
    known = rows.sparkSession.sparkContext.broadcast((np.array(weights).T, [fold for _, fold in settings]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, out = known.value
        right = np.zeros(len(out), np.int64)
        for x, sign, fold, _ in _chunks(batches, size):
            hit = ((x @ by) > 0) == (sign > 0)[:, None]
            right += (hit & (fold[:, None] == np.array(out))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(right)], names=["setting", "n"])
    found = _rows(rows).mapInArrow(count, "setting int, n long").groupBy("setting").agg(F.sum("n").alias("n")).collect()
    return [n for _, n in sorted((r["setting"], r["n"]) for r in found)]
