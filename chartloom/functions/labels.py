"""Label and prediction columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

SCORES = range(7)


def encode_category(c: Column, codes: dict[str, int]) -> Column:
    """Known category to its code; anything else becomes null."""
    return reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), list(codes.items())[1:],
                  F.when(c == next(iter(codes)), F.lit(next(iter(codes.values())))))


SEX_CODES = {"Male": 0, "Female": 1}
EXTERNAL_SEX_CODES = {"M": 0, "F": 1}


def expired_flag(mrs: Column) -> Column:
    return F.when(mrs == 6, 1).otherwise(0)


def expired_flag_external(label: Column, follow_up: Column, reset_follow_up: bool = True) -> Column:
    """From the label text; a follow-up visit counts as not expired unless told otherwise."""
    flag = F.when(F.contains(label, F.lit("Deceased")), 1).otherwise(0)
    return F.when(follow_up == 1, 0).otherwise(flag) if reset_follow_up else flag


def normalise_label(label: Column) -> Column:
    """`4 - Moderately severe ...` -> 4, `Deceased` -> 6, plain numbers as they are, else null."""
    coded = F.coalesce(
        *[F.when(F.contains(label, F.lit(f"{n} -")), F.lit(float(n))) for n in SCORES],
        F.when(F.contains(label, F.lit("Deceased")), F.lit(6.0)))
    return F.coalesce(coded, label.try_cast("double"))


def dichotomise(mrs: Column) -> Column:
    """0-2 -> 0, 3-6 -> 1."""
    return F.when(mrs >= 3, 1).when(mrs < 3, 0)


def clip(c: Column, low: float = 0.0, high: float = 6.0) -> Column:
    return F.when(c.isNull(), None).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def override_prediction(prediction: Column, expired: Column, extracted: Column | None = None,
                        expired_value: float = 6.0) -> Column:
    """Expired wins over the model, an extracted score wins over both."""
    ruled = F.when(expired == 1, F.lit(expired_value)).otherwise(prediction)
    return ruled if extracted is None else F.coalesce(extracted, ruled)


def override_probabilities(zero: Column, one: Column, decided: Column) -> tuple[Column, Column]:
    """Hard probabilities where `decided` holds a label; soft ones where it is null."""
    return (F.when(decided.isNotNull(), 1.0 - decided).otherwise(zero),
            F.when(decided.isNotNull(), decided.cast("double")).otherwise(one))


def argmax_label(zero: Column, one: Column) -> Column:
    """Ties go to the lower class."""
    return (one > zero).cast("int")


def one_hot(label: Column, classes) -> list[Column]:
    """One 0/1 column per listed class, also for classes that do not occur."""
    return [F.coalesce((label == k).cast("int"), F.lit(0)).alias(f"class_{k}") for k in classes]


def row_min(*columns: Column) -> Column:
    """Null-skipping minimum across columns."""
    return F.least(*columns)
