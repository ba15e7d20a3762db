"""Bootstrap replicates as vectors: a row's weights in all replicates are one array, made where it is needed.

A row carries two seeds; its weights follow from them by arithmetic (`functions.hashing`), so what travels
is the rows themselves, once per order, and one vector of totals per range of values:

- `replicate_sums` adds up weighted columns inside the tasks and sends on one row per task and replicate,
- `scan` deals rows over value ranges, gets each range's totals, carries them across the ranges and then
  walks through each range with what lies before it.

Rows of equal values that a third of the table may share are combined before they are dealt out: within a
task, `HOT` or more rows of a batch that agree in all values become one row with the sum of their weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructType

from chartloom.functions.hashing import PRIME, SECOND, with_row_seeds

REPLICATES = 1000
BLOCK = 512               # rows whose weights are held at once
VECTOR = ArrayType(DoubleType())
HOT = 64                  # equal rows of a batch that become one


def poisson_cuts() -> list[int]:
    """Upper ends of the draws that give weight 0, 1, 2, ...: Poisson(1) over the residues."""
    cuts, total = [], 0.0
    for k in range(12):
        total += exp(-1) / factorial(k)
        cuts.append(int(total * PRIME))
    return cuts


CUTS = np.array(poisson_cuts(), dtype=np.int64)


def _residues(row: np.ndarray, replicate: np.ndarray, seed: int) -> np.ndarray:
    """The same two rounds as the column expressions of `functions.hashing`."""
    factor = (replicate * 48271 + (seed * 69621 + 16807)) % PRIME
    shift = (replicate * 39373 + (seed * 742938285 % PRIME + 1)) % PRIME
    first = (row[:, None] * (factor + 1) + shift) % PRIME
    return ((first ^ (first >> 15)) % PRIME * 630360016 + factor) % PRIME


def draws(row: np.ndarray, row2: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Residues, one line per row and one column per replicate."""
    replicate = np.arange(replicates, dtype=np.int64)
    return (_residues(row, replicate, seed) + _residues(row2, replicate, seed + SECOND)) % PRIME


def weights(row: np.ndarray, row2: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, one line per row and one column per replicate."""
    return np.searchsorted(CUTS, draws(row, row2, replicates, seed), side="right").astype(np.float64)


def seeded(df: DataFrame, row_key: str | list[str]) -> DataFrame:
    """Add the seeds `_row` and `_row2`. `row_key` must tell all rows apart (several columns may): rows with
    the same key are drawn together."""
    keys = [row_key] if isinstance(row_key, str) else row_key
    key = F.col(keys[0]) if len(keys) == 1 else F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return with_row_seeds(df, key)


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _key_groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key values, row numbers) of the few groups of a batch."""
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    codes, values = np.zeros(batch.num_rows, dtype=np.int64), []
    for k in keys:
        coded = batch.column(k).dictionary_encode(null_encoding="encode")
        values.append(coded.dictionary.to_pylist())
        codes = codes * len(values[-1]) + coded.indices.to_numpy(zero_copy_only=False)
    for code in np.unique(codes):
        rest, named = int(code), []
        for v in reversed(values):
            rest, at = divmod(rest, len(v))
            named.append(v[at])
        yield tuple(reversed(named)), np.flatnonzero(codes == code)


def replicate_sums(df: DataFrame, row_key: str | list[str], columns: dict[str, Column], extremes: dict[str, Column],
                   keys: list[str] = (), replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(keys, rep, <columns>, min_<extremes>, max_<extremes>): per replicate the weighted sum of each of
    `columns` and the range of each of `extremes` over the rows it draws. Few different keys; a task sends on one row per key and replicate."""
    keys = list(keys)
    values = {**columns, **{f"_x_{k}": v for k, v in extremes.items()}}
    rows = seeded(df, row_key).select(*keys, "_row", "_row2", *[v.cast("double").alias(k) for k, v in values.items()])
    names, wide = list(columns), list(extremes)
    schema = StructType([rows.schema[k] for k in keys]).add("rep", "integer")
    for name in (*names, *(f"{end}_{x}" for x in wide for end in ("min", "max"))):
        schema = schema.add(name, "double")
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            row, row2 = _numbers(batch.column("_row")), _numbers(batch.column("_row2"))
            data = np.stack([_numbers(batch.column(c)) for c in names], axis=1)
            ends = [_numbers(batch.column(f"_x_{x}")) for x in wide]
            for key, at in _key_groups(batch, keys):
                held = totals.setdefault(key, [np.zeros((len(names), replicates))] + [
                    np.full(replicates, v) for _ in wide for v in (np.inf, -np.inf)])
                for start in range(0, len(at), BLOCK):
                    mine = at[start:start + BLOCK]
                    w = weights(row[mine], row2[mine], replicates, seed)
                    held[0] += data[mine].T @ w
                    for i, values in enumerate(ends):
                        drawn = np.where(w > 0, values[mine][:, None], np.nan)
                        held[1 + 2 * i] = np.fmin(held[1 + 2 * i], np.fmin.reduce(drawn))
                        held[2 + 2 * i] = np.fmax(held[2 + 2 * i], np.fmax.reduce(drawn))
        for key, (sums, *limits) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v] * replicates, arrow.field(k).type) for k, v in zip(keys, key)), pa.array(np.arange(replicates, dtype=np.int32)),
                 *(pa.array(s) for s in sums), *(pa.array(x, mask=~np.isfinite(x)) for x in limits)], schema=arrow)

    merged = rows.mapInArrow(add, schema).groupBy(*keys, "rep")
    return merged.agg(*[F.sum(c).alias(c) for c in names], *[getattr(F, end)(f"{end}_{x}").alias(f"{end}_{x}") for x in wide for end in ("min", "max")])


# ---- scans over value ranges -------------------------------------------------------------------

def combined(df: DataFrame, values: list[str], replicates: int, seed: int) -> DataFrame:
    """(values, _row, _row2, _w): rows as they are, but many equal ones of a batch as one with their weights summed.

    `_w` is null for a row by itself: its weights follow from the seeds.
    """
    schema = StructType([df.schema[c] for c in values]).add("_row", "long").add("_row2", "long").add("_w", VECTOR)
    arrow = to_arrow_schema(schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            single = np.ones(batch.num_rows, dtype=bool)
            out = []
            for key, at in _key_groups(batch, values):
                if len(at) < HOT:
                    continue
                single[at] = False
                row, row2 = (_numbers(batch.column(c)) for c in ("_row", "_row2"))
                total = sum(weights(row[x], row2[x], replicates, seed).sum(axis=0) for x in np.array_split(at, -(-len(at) // BLOCK)))
                out.append((*key, 0, 0, total))
            rest = batch.filter(pa.array(single))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*(rest.column(c) for c in values), rest.column("_row"), rest.column("_row2"), pa.nulls(rest.num_rows, arrow.field("_w").type)], schema=arrow)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select(*values, "_row", "_row2").mapInArrow(gather, schema)


class Rows:
    """The rows of one range in a task: sorted values, and their weights in blocks."""

    def __init__(self, table: pa.Table, order: str, descending: bool, replicates: int, seed: int):
        values = _numbers(table.column(order)).astype(np.float64)
        self.by = np.argsort(-values if descending else values, kind="stable")
        self.table, self.values, self.replicates, self.seed = table, values[self.by], replicates, seed
        self.own = _numbers(table.column("_w").is_null())[self.by].astype(bool)
        self.row, self.row2 = (_numbers(table.column(c))[self.by] for c in ("_row", "_row2"))

    def __len__(self) -> int:
        return len(self.values)

    def column(self, name: str) -> np.ndarray:
        return _numbers(self.table.column(name))[self.by]

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Spans of the sorted rows, and (rows, replicates) weights."""
        for start in range(0, len(self), BLOCK):
            span = slice(start, min(len(self), start + BLOCK))
            w = weights(self.row[span], self.row2[span], self.replicates, self.seed)
            for at in np.flatnonzero(~self.own[span]):
                w[at] = self.table.column("_w")[int(self.by[start + at])].values.to_numpy()
            yield span, w


def scan(rows: DataFrame, keys: list[str], order: str, totals: Callable[[Rows], np.ndarray],
         walk: Callable[[Rows, np.ndarray, np.ndarray], Iterator[dict]], schema: StructType, *, descending: bool = False,
         replicates: int = REPLICATES, seed: int = 1, read: Callable = Rows) -> DataFrame:
    """Walk through `rows` (keys, _range, order, ...) along `order`: what `walk` yields, with the keys.

    `totals` gives a range's vector; `walk` gets the rows of a range, the sum of the vectors of all ranges
    before it and of all ranges. Ranges and keys are dealt over the cluster; one vector per range
    meets the others of its key in one task.
    """
    group = [*keys, "_range"]
    named = StructType([rows.schema[k] for k in group])
    arrow_group = to_arrow_schema(named)
    vectors = StructType(list(named.fields)).add("sums", VECTOR)
    carried = StructType(list(named.fields)).add("before", VECTOR).add("whole", VECTOR)
    out = StructType([rows.schema[k] for k in keys] + schema.fields)
    arrow_vectors, arrow_carried, arrow_out = (to_arrow_schema(s) for s in (vectors, carried, out))
    n_keys = len(keys)

    def add(table: pa.Table) -> pa.Table:
        sums = totals(read(table, order, descending, replicates, seed))
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in group), pa.array([sums], pa.list_(pa.float64()))], schema=arrow_vectors)

    def carry(table: pa.Table) -> pa.Table:
        by = np.argsort(_numbers(table.column("_range")) * (-1 if descending else 1))
        sums = np.stack([table.column("sums")[int(i)].values.to_numpy() for i in by])
        until = np.cumsum(sums, axis=0)
        return pa.Table.from_arrays([*(table.column(c).take(pa.array(by)) for c in group),
                                     *(pa.array(list(x), pa.list_(pa.float64())) for x in (until - sums, np.broadcast_to(until[-1], sums.shape)))],
                                    schema=arrow_carried)

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows:
            before, whole = (right.column(c)[0].values.to_numpy() for c in ("before", "whole"))
            found = list(walk(read(left, order, descending, replicates, seed), before, whole))
        named_columns = [pa.array([left.column(k)[0].as_py()] * len(found), arrow_group.field(k).type) for k in group[:n_keys]]
        return pa.Table.from_arrays([*named_columns, *(pa.array([f[x.name] for f in found], x.type) for x in list(arrow_out)[n_keys:])], schema=arrow_out)

    per_range = rows.groupBy(*group).applyInArrow(add, vectors)
    everything = per_range.withColumn("_every", F.lit(0)) if not keys else per_range
    before = everything.groupBy(*(keys or ["_every"])).applyInArrow(
        lambda table: carry(table.select([*group, "sums"])), carried)
    return rows.groupBy(*group).cogroup(before.groupBy(*group)).applyInArrow(go, out)


def summed(vectors: DataFrame, keys: list[str], column: str, names: list[str], replicates: int) -> DataFrame:
    """(keys, rep, <names>): the sum over all rows of a key of `column`, an array of one stretch of replicates per name.

    One row per range and key meets the others of its key in one task.
    """
    schema = StructType([vectors.schema[k] for k in keys]).add("rep", "integer")
    for name in names:
        schema = schema.add(name, "double")
    arrow = to_arrow_schema(schema)

    def add(table: pa.Table) -> pa.Table:
        total = sum(x.values.to_numpy() for chunk in table.column(column).chunks for x in chunk).reshape(len(names), replicates)
        return pa.Table.from_arrays([*(pa.array([table.column(k)[0].as_py()] * replicates, arrow.field(k).type) for k in keys),
                                     pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(x) for x in total)], schema=arrow)

    ready = vectors if keys else vectors.withColumn("_every", F.lit(0))
    return ready.groupBy(*(keys or ["_every"])).applyInArrow(add, schema)
