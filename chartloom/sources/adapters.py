"""Tables of another site under our names and codes, and a table of what could not be read.

A site is declared by which of its columns stands for which of ours, by code lists, and by how its texts are
read. Code lists are tables that are joined to the rows: as many rows as the declaration lists, so they are
broadcast. A value that is in no list, or that its reader returns as null, sends the row to the rejects with
the column and the value named; no row vanishes and none is kept with a hole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class SiteAdapter:
    """`columns`: our name -> the site's. `codes`: our name -> {the site's value: ours}, compared without
    surrounding blanks. `readers`: our name -> what makes a value of the site's text, null if it cannot.
    `required`: our names that may not be empty; elsewhere an empty value stays empty."""

    columns: dict[str, str]
    codes: dict[str, dict[str, int]] = field(default_factory=dict)
    readers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class Adapted:
    rows: DataFrame        # the site's other columns, then ours
    rejects: DataFrame     # (keys, field, value): one row per value that could not be read


def adapt(df: DataFrame, site: SiteAdapter, keys: list[str]) -> Adapted:
    """`keys` name our columns, or the site's that no other name stands for, that tell a reject's row."""
    taken = set(site.columns.values())
    named = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in taken and c not in site.columns],
                      *[F.col(f"`{theirs}`").alias(ours) for ours, theirs in site.columns.items()])
    originals = {c: f"_was_{c}" for c in {**site.codes, **site.readers, **dict.fromkeys(site.required)}}
    read = named.withColumns({was: F.col(f"`{c}`").cast("string") for c, was in originals.items()})
    for column, codes in site.codes.items():
        listed = df.sparkSession.createDataFrame(list(codes.items()), "_raw string, _code int")
        read = (read.drop(column).join(F.broadcast(listed), F.trim(originals[column]) == F.col("_raw"), "left")
                .withColumnRenamed("_code", column).drop("_raw"))
    read = read.withColumns({column: reader(F.col(originals[column])) for column, reader in site.readers.items()})

    def lost(column: str) -> Column:
        empty = F.col(originals[column]).isNull() | (F.trim(originals[column]) == "")
        unread = F.col(f"`{column}`").isNull() & ~empty if column in site.codes or column in site.readers else F.lit(False)
        return unread | empty if column in site.required else unread

    checked = read.withColumn("_lost", F.array_compact(F.array(*[
        F.when(lost(c), F.struct(F.lit(c).alias("field"), F.col(was).alias("value"))) for c, was in sorted(originals.items())])))
    order = [c for c in named.columns]
    good = checked.where(F.size("_lost") == 0).select(*[F.col(f"`{c}`") for c in order])
    # a reject is known by what the site wrote
    known = [F.col(originals[k] if k in originals else f"`{k}`").alias(k) for k in keys]
    return Adapted(good, checked.where(F.size("_lost") > 0).select(*known, F.explode("_lost").alias("_one")).select(*keys, "_one.field", "_one.value"))


def text_age(text: Column) -> Column:
    """Whole years; `>89`, as de-identified exports have it, is 90."""
    years = F.regexp_extract(F.trim(text), r"^(\d{1,3})$", 1)
    return F.when(F.trim(text) == ">89", F.lit(90)).otherwise(F.when(years != "", years).cast("int"))
