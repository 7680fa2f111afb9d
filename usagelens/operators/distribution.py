"""How hours spread over an item's or all users: percentiles, Gini, Lorenz, histograms, box plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import ordered
from usagelens.functions.frames import top
from usagelens.functions.numeric import ratio
from usagelens.operators.usage import hours_by_user, measured_plays, user_item_hours_max
from usagelens.session import materialize


def hour_runs(interactions: DataFrame) -> DataFrame:
    """Ordered hours per item, one value per (user, item); shared by the reports below."""
    return ordered.value_runs(user_item_hours_max(interactions), ["item"], "hours")


def mean_vs_median_by_item(interactions: DataFrame, min_players: int = 50) -> DataFrame:
    """How far outliers pull the mean from the median."""
    stats = hour_runs(interactions).groupBy("item").agg(
        ordered.count_of_runs().alias("players"),
        ordered.mean_of_runs().alias("mean_hours"),
        *[ordered.percentile_of_runs("hours", p).alias(name)
          for name, p in {"median_hours": 0.5, "q25": 0.25, "q75": 0.75}.items()],
        ordered.stddev_of_runs("hours").alias("std_hours"),
    )
    mean, median = F.col("mean_hours"), F.col("median_hours")
    return stats.where(F.col("players") >= min_players).select(
        "*",
        (F.col("q75") - F.col("q25")).alias("iqr"),
        (mean - median).alias("diff_mean_median"),
        ratio(mean, median).alias("ratio_mean_median"),
        ratio(F.col("std_hours"), mean).alias("cov"),
    )


def top_mean_median_gap(interactions: DataFrame, min_players: int = 50, n: int = 20) -> DataFrame:
    gaps = mean_vs_median_by_item(interactions, min_players)
    return top(gaps, n, F.desc("diff_mean_median"), "item")


def mean_median_bubble_points(interactions: DataFrame, min_players: int = 50) -> DataFrame:
    """Median against mean, sized by the order of magnitude of players."""
    return mean_vs_median_by_item(interactions, min_players).select(
        F.col("item").alias("label"), F.col("median_hours").alias("x"), F.col("mean_hours").alias("y"),
        (F.log10(F.col("players") + 1.0) * 30).alias("size"))


def tail_percentiles_by_item(interactions: DataFrame, min_players: int = 100) -> DataFrame:
    """Weight of the tail: high percentiles against middle ones, and the Gini coefficient."""
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    stats = hour_runs(interactions).groupBy("item").agg(
        ordered.count_of_runs().alias("players"),
        *[ordered.percentile_of_runs("hours", p).alias(name) for name, p in shares.items()],
        ordered.mean_of_runs().alias("mean_hours"),
        ordered.gini_of_runs("hours").alias("gini"),
    )
    return stats.where(F.col("players") >= min_players).select(
        "*",
        ratio(F.col("p90"), F.col("p50")).alias("ratio_p90_p50"),
        ratio(F.col("p75"), F.col("p25")).alias("ratio_p75_p25"),
    )


def gini_by_item(interactions: DataFrame) -> DataFrame:
    return hour_runs(interactions).groupBy("item").agg(
        ordered.count_of_runs().alias("players"), ordered.gini_of_runs("hours").alias("gini"))


def active_hours_by_user(interactions: DataFrame) -> DataFrame:
    """Total hours of users who played for any time."""
    return hours_by_user(interactions.where(F.col("hours") > 0))


def gini_users(interactions: DataFrame) -> DataFrame:
    """One row: inequality of total hours over users, by area and exact."""
    runs = ordered.value_runs(active_hours_by_user(interactions), [], "total_hours")
    return runs.agg(ordered.trapezoid_gini_of_runs("total_hours").alias("gini"),
                    ordered.gini_of_runs("total_hours").alias("gini_exact"))


def _lorenz(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    rows = values.withColumn("_one", F.lit(1))
    return ordered.running_totals(rows, keys, [value, "user_id"], ["_one", value])


def _cumulative_share(value: str) -> Column:
    reached = F.col(f"{value}_before") + F.col(value)
    return F.when(F.col(f"{value}_all") > 0, reached / F.col(f"{value}_all"))


def _largest_items(rows: DataFrame, n: int) -> DataFrame:
    """The n items with most distinct users among the rows."""
    users = rows.groupBy("item").agg(F.count_distinct("user_id").alias("players"))
    return top(users, n, F.desc("players"), "item").select("item")


def lorenz_top_items(interactions: DataFrame, n: int = 5) -> DataFrame:
    """Lorenz points of the items with most players; x runs evenly from 0 to 1."""
    hours = materialize(user_item_hours_max(interactions))  # one row per pair, read twice
    points = _lorenz(hours.join(_largest_items(hours, n), "item", "left_semi"), ["item"], "hours")
    rank, count = F.col("_one_before") + 1, F.col("_one_all")
    reached = F.col("hours_before") + F.col("hours")
    return points.select(
        "item", rank.alias("rank"),
        F.coalesce(ratio(F.col("_one_before"), count - 1), F.lit(0.0)).alias("user_share"),
        F.coalesce(_cumulative_share("hours"), reached).alias("hours_share"))


def lorenz_users(interactions: DataFrame) -> DataFrame:
    """Lorenz points of all users by total hours."""
    points = _lorenz(active_hours_by_user(interactions), [], "total_hours")
    rank = F.col("_one_before") + 1
    return points.select(
        "user_id", rank.alias("rank"), ratio(rank, F.col("_one_all")).alias("user_share"),
        F.coalesce(_cumulative_share("total_hours"), F.lit(0.0)).alias("hours_share"))


def histogram(runs: DataFrame, keys: list[str], value: str, low: Column, high: Column, bins: int) -> DataFrame:
    """Rows per equal-width bin over [low, high]; the last bin is closed, empty bins count 0.

    `runs` holds `n` rows per value; a range of no width is opened by half a unit on both sides.
    """
    flat = low == high
    left = F.when(flat, low - 0.5).otherwise(low)
    right = F.when(flat, high + 0.5).otherwise(high)
    ranged = runs.withColumn("_low", left).withColumn("_high", right)
    step = (F.col("_high") - F.col("_low")) / bins
    inside = ranged.where(F.col(value).between(F.col("_low"), F.col("_high"))).withColumn("_step", step)
    guess = F.least(F.floor((F.col(value) - F.col("_low")) / F.col("_step")), F.lit(bins - 1))

    # The division may land one bin off; the bin edges decide.
    def edge(i: Column) -> Column:
        return F.col("_low") + i * F.col("_step")

    placed = inside.withColumn("_guess", guess).withColumn(
        "bin",
        F.when(F.col(value) < edge(F.col("_guess")), F.col("_guess") - 1)
        .when((F.col("_guess") < bins - 1) & (F.col(value) >= edge(F.col("_guess") + 1)), F.col("_guess") + 1)
        .otherwise(F.col("_guess")).cast("int"))
    counts = placed.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    frames = ranged.groupBy(*keys).agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    all_bins = frames.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_high") - F.col("_low")) / bins
    return all_bins.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("_low") + F.col("bin") * width).alias("bin_start"),
        (F.col("_low") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("entries"))


def _top_item_runs(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Ordered values of the n items with most players."""
    rows = materialize(rows.select("user_id", "item", value))  # read twice
    kept = rows.join(_largest_items(rows, n), "item", "left_semi")
    return ordered.value_runs(kept, ["item"], value)


def hours_histogram_by_item(interactions: DataFrame, n: int = 20, bins: int = 20,
                            upper_share: float = 0.95) -> DataFrame:
    """Play hours of the largest items, each from 0 to its own upper percentile."""
    runs = _top_item_runs(measured_plays(interactions), "hours", n)
    limits = runs.groupBy("item").agg(ordered.percentile_of_runs("hours", upper_share).alias("limit"))
    ranged = runs.join(limits, "item")
    return histogram(ranged, ["item"], "hours", F.lit(0.0), F.col("limit"), bins)


def hours_histogram_users(interactions: DataFrame, bins: int = 50) -> DataFrame:
    """Total hours over users, from the least to the most."""
    counts = materialize(ordered.value_counts(active_hours_by_user(interactions), [], "total_hours"))
    span = counts.agg(F.struct(F.min("total_hours").alias("low"), F.max("total_hours").alias("high"))).scalar()
    ranged = counts.withColumn("_span", span)
    return histogram(ranged, [], "total_hours", F.col("_span.low"), F.col("_span.high"), bins)


def _box_stats(runs: DataFrame, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest value within `reach` box heights) and values beyond them.

    For runs of a fixed number of items; the boxes have one row per item.
    """
    boxes = runs.groupBy("item").agg(
        ordered.count_of_runs().alias("entries"),
        *[ordered.percentile_of_runs(value, p).alias(name)
          for name, p in {"q1": 0.25, "median": 0.5, "q3": 0.75}.items()])
    v, q1, q3 = F.col(value), F.col("q1"), F.col("q3")
    fence = reach * (q3 - q1)
    both = runs.drop("mass").join(boxes, "item")
    return both.groupBy("item", "entries", "q1", "median", "q3").agg(
        F.least(F.min(F.when(v >= q1 - fence, v)), q1).alias("whisker_low"),
        F.greatest(F.max(F.when(v <= q3 + fence, v)), q3).alias("whisker_high"),
        F.sum(F.when((v < q1 - fence) | (v > q3 + fence), F.col("n")).otherwise(0)).alias("outliers"),
    )


def hours_boxstats_by_item(interactions: DataFrame, n: int = 20) -> DataFrame:
    return _box_stats(_top_item_runs(measured_plays(interactions), "hours", n), "hours")


def log_hours_boxstats_by_item(interactions: DataFrame, n: int = 20) -> DataFrame:
    """Box plot numbers on log10(hours + 1), one value per (user, item); outliers stay hidden."""
    logs = user_item_hours_max(interactions).select(
        "user_id", "item", F.log10(F.col("hours") + 1.0).alias("log_hours"))
    return _box_stats(_top_item_runs(logs, "log_hours", n), "log_hours").drop("outliers")
