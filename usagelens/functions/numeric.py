"""Number parsing, guarded arithmetic and simple scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def to_double(text: Column) -> Column:
    """Text as double, NULL where it is not a number (`1d` and `2f` are not)."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double, NULL on a zero or missing divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Value held inside [low, high]; NULL stays NULL."""
    held = value
    if low is not None:
        held = F.greatest(held, F.lit(float(low)))
    if high is not None:
        held = F.least(held, F.lit(float(high)))
    return F.when(value.isNotNull(), held)


def flag(condition: Column) -> Column:
    """1.0 where true, else 0.0: ready for sum and avg."""
    return F.when(condition, 1.0).otherwise(0.0)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
