"""Group-wise operators: ordered concatenation, latest rows, group totals, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.functions.text import collapse_whitespace, dedupe_words


def concat_ordered(df: DataFrame, keys: list[str], order: list[str], text: str,
                   out: str | None = None, dedupe: bool = False) -> DataFrame:
    """Join the text pieces of each group in `order` with blanks, then collapse white space.

    Order lives inside the aggregate (a sorted list of structs), so the result does not depend
    on how rows arrive. The text itself breaks ties. A null piece counts as empty. Rows with a
    null key are dropped. What a task gathers for a group is the one text value it returns: group
    by note or document, never by something wider.
    """
    piece = F.struct(*[F.col(o) for o in order], F.coalesce(F.col(text), F.lit("")).alias("_piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["_piece"]), " ")
    tidy = collapse_whitespace(joined)
    if dedupe:
        tidy = dedupe_words(tidy)
    return df.na.drop(subset=keys).groupBy(*keys).agg(tidy.alias(out or text))


def latest_per_group(df: DataFrame, keys: list[str], order: str, descending: bool = True) -> DataFrame:
    """Rows on the group's last (or first) value of `order`, ties kept; null keys dropped.

    `rank() == 1` lets Spark prune before the shuffle: every map task sends on only the rows
    that tie at its own extreme, so a large group does not travel whole.
    """
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    window = Window.partitionBy(*keys).orderBy(by)
    return (df.na.drop(subset=[*keys, order])
            .withColumn("_rank", F.rank().over(window)).where("_rank = 1").drop("_rank"))


def having_total(df: DataFrame, keys: list[str], amount: Column, at_least: int) -> DataFrame:
    """Keep the members of groups whose total reaches `at_least`; null keys dropped.

    The total is a partial aggregate and comes back as a semi-join on the keys: group members
    are never gathered in one task.
    """
    known = df.na.drop(subset=keys)
    enough = (known.select(*keys, amount.alias("_amount")).groupBy(*keys)
              .agg(F.sum("_amount").alias("_total")).where(F.col("_total") >= at_least))
    return known.join(enough.select(*keys), keys, "left_semi")


def pivot_max(df: DataFrame, keys: list[str], kind: str, value: str, kinds: list[str],
              suffix: str = "_days") -> DataFrame:
    """One row per key with the largest value of each kind side by side; absent kinds are null."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(kind) == k, F.col(value))).alias(f"{k}{suffix}") for k in kinds])


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack frames with the same columns in any order."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*out.columns))
    return out
