"""Ordered text rewriting."""

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F


def bind(col: Column, body: Callable[[Column], Column]) -> Column:
    """Give `col` a name inside `body`, so that it is evaluated once however often it is used.

    Chaining `when(test(c), change(c)).otherwise(c)` directly triples the tree at every step;
    a one-element transform keeps a long chain linear in size.
    """
    return F.transform(F.array(col), lambda value: body(value))[0]


def replace_all(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements in the given order, each seeing the result of the one before. One Arrow function: a
    chain of native replacements searches every text byte by byte for each pair. Not for use inside `bind`."""
    listed = list(pairs)

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        def change(value: str | None) -> str | None:
            if value is not None:
                for old, new in listed:
                    value = value.replace(old, new)
            return value
        return texts.map(change)
    return replaced(col)


def rewrite_all(col: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Regular-expression replacements in the given order."""
    for pattern, new in rules:
        col = F.regexp_replace(col, pattern, new)
    return col


@dataclass(frozen=True)
class RuleFamily:
    """Rules behind a gate: every text that any of the rules can change holds one of the words
    in `needs` or matches `gate`."""

    name: str
    needs: tuple[str, ...]
    gate: str | None
    rules: tuple[tuple[str, str], ...]

    def concerns(self, text: Column) -> Column:
        tests = [F.contains(text, F.lit(word)) for word in self.needs]
        if self.gate:
            tests.append(text.rlike(self.gate))
        return reduce(lambda a, b: a | b, tests)

    def apply(self, text: Column) -> Column:
        return F.when(self.concerns(text), rewrite_all(text, self.rules)).otherwise(text)


def apply_families(col: Column, families: Iterable[RuleFamily]) -> Column:
    """Run the families in order. A gate reads the current text: an earlier family may have
    written words that a later one looks for."""
    for family in families:
        col = bind(col, family.apply)
    return col
