"""Exact order statistics that never need a whole group in one task.

A window over a group, or `percentile`, keeps the group (or all its distinct values) in one task.
That fails once a group holds a third of a large table. Here rows are range-partitioned on
(group, value), so a large group is cut into consecutive slices; only one total per slice is brought
together, and each slice then adds the totals of the slices before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.numeric import ratio
from usagelens.session import materialize

_SLICE = "_slice"

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   measures: Sequence[str]) -> DataFrame:
    """Add `<m>_before` (sum over earlier rows of the group) and `<m>_all` (sum over the group).

    `order` must make rows of a group distinct; keys must not be NULL. The sliced frame is written to
    the shared folder: both branches below have to see the same slices.
    """
    keys = list(keys)
    sliced = materialize(df.repartitionByRange(*keys, *order).withColumn(_SLICE, F.spark_partition_id()))

    # One row per group and slice; per group no more rows than there are partitions.
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    slices = sliced.groupBy(*keys, _SLICE).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = slices.select(
        *keys, _SLICE,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_all") for m in measures],
    )

    inside = (Window.partitionBy(*keys, _SLICE).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = sliced.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_{m}_local")
                                 for m in measures])
    return local.join(offsets, [*keys, _SLICE]).select(
        *df.columns,
        *[(F.col(f"_{m}_offset") + F.col(f"_{m}_local")).alias(f"{m}_before") for m in measures],
        *[f"{m}_all" for m in measures],
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (keys, value) as `n`, with the value's share of the group sum as `mass`."""
    keys = list(keys)
    kept = df.where(F.col(value).isNotNull())
    for key in keys:
        kept = kept.where(F.col(key).isNotNull())
    counts = kept.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("mass", F.col(value) * F.col("n"))


def value_runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value) in order, with running counts and sums (see `running_totals`)."""
    return running_totals(value_counts(df, keys, value), keys, [value], ["n", "mass"])


def _at_position(value: str, position: Column) -> Column:
    """The value that covers a zero-based position of the sorted group."""
    covers = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
    return F.max(F.when(covers, F.col(value)))


def percentile_of_runs(value: str, share: float) -> Column:
    """Aggregate over `value_runs`: exact percentile with linear interpolation."""
    position = F.lit(float(share)) * (F.col("n_all") - 1)
    low = _at_position(value, F.floor(position))
    high = _at_position(value, F.ceil(position))
    step = F.max(position - F.floor(position))
    return low + (high - low) * step


def count_of_runs() -> Column:
    return F.sum("n")


def mean_of_runs() -> Column:
    return ratio(F.sum("mass"), F.sum("n"))


def stddev_of_runs(value: str) -> Column:
    """Sample standard deviation, from distances to the group mean; NULL below two rows."""
    distance = F.col(value) - F.col("mass_all") / F.col("n_all")
    return F.sqrt(ratio(F.sum(F.col("n") * distance * distance), F.sum("n") - 1))


def _sum_of_running_sums(value: str) -> Column:
    n, v = F.col("n").cast("double"), F.col(value)
    return F.sum(n * F.col("mass_before") + v * n * (n + 1) / 2)


def gini_of_runs(value: str) -> Column:
    """Discrete Gini coefficient; 0 when every value is 0."""
    n, total = F.max("n_all"), F.max("mass_all")
    gini = ((n + 1) - 2 * ratio(_sum_of_running_sums(value), total)) / n
    return F.when(total == 0, F.lit(0.0)).otherwise(gini)


def trapezoid_gini_of_runs(value: str) -> Column:
    """Gini from the area under the Lorenz points 1/n..1, without the origin."""
    n, total = F.max("n_all"), F.max("mass_all")
    ends = (F.min(value) + total) / 2
    area = ratio(_sum_of_running_sums(value) - ends, n * total)
    return F.when(n > 0, 1 - 2 * F.coalesce(area, F.lit(0.0)))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact percentiles of a column per group, one output column per entry of `shares`."""
    runs = value_runs(df, keys, value)
    return runs.groupBy(*keys).agg(*[percentile_of_runs(value, p).alias(name)
                                     for name, p in shares.items()])


def average_rank_shares(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Per (keys, value): mean rank of the value's rows divided by the rows of the group."""
    runs = value_runs(df, keys, value)
    return runs.select(*keys, value,
                       ((F.col("n_before") + (F.col("n") + 1) / 2) / F.col("n_all")).alias(name))


def dense_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct values of a column in sorted order, numbered from 0."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("n", F.lit(1))
    ranked = running_totals(values, [], [column], ["n"])
    return ranked.select(column, F.col("n_before").cast("bigint").alias(code))
