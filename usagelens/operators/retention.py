"""From buying to playing: retention per item, its trend and its quadrants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import ordered
from usagelens.functions.frames import stacked
from usagelens.functions.numeric import count_where, ratio
from usagelens.operators.usage import user_item_facts
from usagelens.schema import HIGH_RETENTION_LABEL, LOW_RETENTION_LABEL, MID_RETENTION_LABEL, QUADRANTS
from usagelens.session import materialize


def retention_by_item(interactions: DataFrame, min_buyers: int = 100) -> DataFrame:
    """Bought items with enough buyers: players per hundred buyers, and mean hours per play row.

    Players need not be buyers, so retention may pass 100.
    """
    per_item = user_item_facts(interactions).groupBy("item").agg(
        count_where(F.col("purchase_rows") > 0).alias("buyers"),
        count_where(F.col("play_rows") > 0).alias("players"),
        F.coalesce(ratio(F.sum("hours_sum"), F.sum("timed_rows")), F.lit(0.0)).alias("avg_playtime"),
    )
    kept = per_item.where((F.col("buyers") > 0) & (F.col("buyers") >= min_buyers))
    return kept.select(
        "item", "buyers", "players",
        (ratio(F.col("players"), F.col("buyers")) * 100).alias("retention_rate"), "avg_playtime")


def high_playtime_items(retention: DataFrame, min_avg_hours: float = 150) -> DataFrame:
    return retention.where(F.col("avg_playtime") > min_avg_hours).orderBy(F.desc("avg_playtime"), "item")


def retention_label(rate: Column, low: int = 40, high: int = 80) -> Column:
    names = {"low": low, "high": high}
    return (F.when(rate < low, LOW_RETENTION_LABEL.format(**names))
            .when(rate <= high, MID_RETENTION_LABEL.format(**names))
            .otherwise(HIGH_RETENTION_LABEL.format(**names)))


def retention_category(retention: DataFrame, low: int = 40, high: int = 80) -> DataFrame:
    return retention.withColumn("retention_category", retention_label(F.col("retention_rate"), low, high))


def retention_medians(retention: DataFrame) -> DataFrame:
    """One row: median retention and median playtime over the kept items."""
    long = stacked(retention, ["retention_rate", "avg_playtime"])
    medians = ordered.percentiles(long, ["metric"], "value", {"median": 0.5})
    return medians.agg(*[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"median_{short}")
                         for m, short in {"retention_rate": "retention", "avg_playtime": "playtime"}.items()])


def retention_trend(retention: DataFrame) -> DataFrame:
    """Least-squares line of retention over playtime, with its value per item."""
    retention = materialize(retention)
    x, y = F.col("avg_playtime"), F.col("retention_rate")
    line = retention.agg(F.struct(F.regr_slope(y, x).alias("slope"),
                                  F.regr_intercept(y, x).alias("intercept"))).scalar()
    return retention.select("item", "avg_playtime", "retention_rate",
                            (line["slope"] * x + line["intercept"]).alias("fitted_retention"))


def retention_quadrants(retention: DataFrame) -> DataFrame:
    """Each item's place against both medians."""
    retention = materialize(retention)
    medians = retention_medians(retention).select(F.struct("*")).scalar()
    upper = F.col("retention_rate") >= medians["median_retention"]
    right = F.col("avg_playtime") >= medians["median_playtime"]
    upper_right, upper_left, lower_right, lower_left = QUADRANTS
    return retention.withColumn(
        "quadrant",
        F.when(upper, F.when(right, upper_right).otherwise(upper_left))
        .otherwise(F.when(right, lower_right).otherwise(lower_left)))


def retention_quadrant_counts(retention: DataFrame) -> DataFrame:
    """Items per quadrant, all four always present, in fixed order."""
    quadrants = retention_quadrants(retention)
    counts = quadrants.agg(*[count_where(F.col("quadrant") == q).alias(q) for q in QUADRANTS])
    cells = [F.struct(F.lit(i).alias("position"), F.lit(q).alias("quadrant"),
                      F.coalesce(F.col(f"`{q}`"), F.lit(0)).cast("bigint").alias("items"))
             for i, q in enumerate(QUADRANTS)]
    return counts.select(F.inline(F.array(*cells))).orderBy("position").drop("position")


def retention_bubble_points(retention: DataFrame) -> DataFrame:
    """Playtime against retention, sized by buyers."""
    return retention.select(F.col("item").alias("label"), F.col("avg_playtime").alias("x"),
                            F.col("retention_rate").alias("y"), (F.col("buyers") / 50).alias("size"))
