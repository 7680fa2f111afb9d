"""What is in a table: types, missing values, distinct values, spread, correlation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from usagelens.functions import ordered
from usagelens.functions.frames import stacked
from usagelens.functions.numeric import count_where, nan_to_null, ratio
from usagelens.schema import PLAY, PURCHASE


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def _present(df: DataFrame, name: str):
    """Column with NaN taken as missing."""
    column = F.col(f"`{name}`")
    return nan_to_null(column) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else column


def _per_column(one_row: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    return one_row.unpivot([], list(names), "column_name", value)


def profile_columns(df: DataFrame) -> DataFrame:
    """Column name, type and non-null count."""
    counts = df.agg(*[F.count(_present(df, c)).alias(c) for c in df.columns])
    types = F.create_map(*[F.lit(x) for name, kind in df.dtypes for x in (name, kind)])
    return _per_column(counts, df.columns, "non_null").select(
        "column_name", types[F.col("column_name")].alias("data_type"), "non_null")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    counts = df.agg(*[count_where(_present(df, c).isNull()).alias(c) for c in df.columns])
    return _per_column(counts, df.columns, "nulls")


def describe_numeric(df: DataFrame) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of every numeric column."""
    names = numeric_columns(df)
    doubles = df.select(*[_present(df, c).cast("double").alias(c) for c in names])
    runs = ordered.value_runs(stacked(doubles, names, "column_name"), ["column_name"], "value")
    return runs.groupBy("column_name").agg(
        ordered.count_of_runs().alias("count"),
        ordered.mean_of_runs().alias("mean"),
        ordered.stddev_of_runs("value").alias("std"),
        F.min("value").alias("min"),
        *[ordered.percentile_of_runs("value", p).alias(name)
          for name, p in {"p25": 0.25, "p50": 0.5, "p75": 0.75}.items()],
        F.max("value").alias("max"),
    )


def distinct_counts(interactions: DataFrame, exact: bool = True) -> DataFrame:
    """Number of users and of items; `exact=False` uses sketches."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return interactions.agg(count("user_id").alias("users"), count("item").alias("items"))


def distinct_items(interactions: DataFrame) -> DataFrame:
    return interactions.select("item").distinct()


def behavior_counts(interactions: DataFrame) -> DataFrame:
    return interactions.agg(count_where(F.col("behavior") == PURCHASE).alias("purchases"),
                            count_where(F.col("behavior") == PLAY).alias("plays"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of all numeric column pairs, over rows where both are present.

    One pass computes all pairs. A constant column gives NULL, also with itself.
    """
    names = list(columns or numeric_columns(df))
    doubles = df.select(*[_present(df, c).cast("double").alias(c) for c in names])

    def pearson(a: str, b: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    cells = doubles.agg(*[pearson(a, b).alias(f"{i}_{j}")
                          for (i, a), (j, b) in product(enumerate(names), repeat=2) if i <= j])
    pairs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                      F.col(f"{min(i, j)}_{max(i, j)}").alias("correlation"))
             for (i, a), (j, b) in product(enumerate(names), repeat=2)]
    return cells.select(F.inline(F.array(*pairs)))


def text_column_cardinality(df: DataFrame) -> DataFrame:
    """Distinct values per text column (a missing value counts as one), with column position."""
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    counts = df.agg(*[(F.count_distinct(F.col(f"`{c}`")) + F.max(F.col(f"`{c}`").isNull().cast("int")))
                      .cast("bigint").alias(c) for c in names])
    positions = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    return _per_column(counts, names, "distinct_values").withColumn(
        "position", positions[F.col("column_name")])
