"""Small reshaping helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows with a missing group key."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those wanted columns the frame has, in the wanted order."""
    return [name for name in wanted if name in df.columns]


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First n rows of an order; callers end the order with a unique key."""
    return df.orderBy(*order).limit(n)


def stacked(df: DataFrame, columns: Sequence[str], name: str = "metric", value: str = "value",
            keep: Sequence[str] = ()) -> DataFrame:
    """Wide to long over numeric columns, one row per column."""
    return df.select(*keep, *columns).unpivot(list(keep), list(columns), name, value)
