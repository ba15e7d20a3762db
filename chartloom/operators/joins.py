"""Joins of admissions, note lines and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# rows that a task of a join sorts: some 240 bytes each
LINES_A_TASK = 500_000


def interval_join(left: DataFrame, lines: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """Equi-join on `key` where `low <= point <= high`, both ends included.

    The band is a residual predicate of the equi-join, never a cross product. Each side is read and
    shuffled once; the lines of a key that owns a large share of them are split at run time by
    adaptive execution (`spark.sql.adaptive.skewJoin`), which needs no count beforehand.
    """
    return left.join(lines, key).where(F.col(point).between(F.col(low), F.col(high)))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """`df` by `key` over as many partitions as hold `LINES_A_TASK` rows each, for a join that sorts it; as it is where the
    shuffle partitions are enough. For keys of few rows each: partitions asked for by number are not split at run time."""
    asked = -(-df.count() // LINES_A_TASK)
    return df if asked <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(asked, key)


def adults(df: DataFrame, age: str = "Age", at_least: int = 18) -> DataFrame:
    return df.where(F.col(age) >= at_least)


def keep_listed(df: DataFrame, listed: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key occurs in `listed`; lifts a line-level match to all lines of the note."""
    keys = [key] if isinstance(key, str) else key
    return df.join(listed.select(*keys).distinct(), keys, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, key: str | list[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.join(listed.select(*keys).distinct(), keys, "left_anti")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def drop_listed_null_safe(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Anti-join in which a missing key part matches a missing key part."""
    right = listed.select(*keys).distinct()
    return df.join(right, null_safe(df, right, keys), "left_anti")


def attach(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Inner join with the distinct (keys, columns) of `other`; fans out if they differ per key."""
    return df.join(other.select(*keys, *columns).distinct(), keys)


def enrich(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join: rows without a match keep null. `other` must hold a key at most once."""
    return df.join(other, keys, "left")
