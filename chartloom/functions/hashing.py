"""Portable hashes: the same rows are drawn on any cluster, and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Mersenne prime 2^31 - 1: products of two residues stay inside a long
PRIME = 2147483647
# distance of the two seeds' factors
SECOND = 7919


def hash32(value: Column) -> Column:
    """First 32 bits of the md5 of the value's text, as a long."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def with_row_seeds(df: DataFrame, key: Column) -> DataFrame:
    """Add `_row` and `_row2`, residues from two words of the key's md5: rows are drawn alike only if
    they agree in both."""
    hashed = F.md5(key.cast("string").cast("binary"))
    return (df.withColumn("_row", F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % PRIME)
            .withColumn("_row2", F.conv(F.substring(hashed, 9, 8), 16, 10).cast("long") % PRIME))


# The draw of a (row, replicate): the sum, mod PRIME, of one residue for each seed of the row, made by
# arithmetic per replicate. Two multiply-add rounds with a shift between them; the factors depend on the
# replicate only, so within a replicate the rows' draws are spread evenly. The rounds are two
# columns, because the second uses the first twice.

def _factor(replicate: Column, seed: int) -> Column:
    return (replicate * 48271 + (seed * 69621 + 16807)) % PRIME


def first_round(row: Column, replicate: Column, seed: int) -> Column:
    shift = (replicate * 39373 + (seed * 742938285 % PRIME + 1)) % PRIME
    return (row * (_factor(replicate, seed) + 1) + shift) % PRIME


def second_round(first: Column, replicate: Column, seed: int) -> Column:
    mixed = first.bitwiseXOR(F.shiftright(first, 15)) % PRIME
    return (mixed * 630360016 + _factor(replicate, seed)) % PRIME


def with_draw(df: DataFrame, replicate: str, seed: int, out: str) -> DataFrame:
    rep = F.col(replicate).cast("long")
    return (df.withColumn("_first", first_round(F.col("_row"), rep, seed))
            .withColumn("_second", first_round(F.col("_row2"), rep, seed + SECOND))
            .withColumn(out, (second_round(F.col("_first"), rep, seed) + second_round(F.col("_second"), rep, seed + SECOND)) % PRIME)
            .drop("_first", "_second"))
