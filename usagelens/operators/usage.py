"""Row filters and per-item, per-user totals of the interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.frames import top, where_keys
from usagelens.functions.numeric import count_where, flag, ratio, to_double
from usagelens.schema import PLAY, PURCHASE


def _is(behavior: str):
    return F.col("behavior") == behavior


def plays(interactions: DataFrame) -> DataFrame:
    return interactions.where(_is(PLAY))


def purchases(interactions: DataFrame) -> DataFrame:
    return interactions.where(_is(PURCHASE))


def known_behavior(interactions: DataFrame) -> DataFrame:
    return interactions.where(F.col("behavior").isin(PLAY, PURCHASE))


def active_plays(interactions: DataFrame) -> DataFrame:
    """Plays that took any time."""
    return interactions.where(_is(PLAY) & (F.col("hours") > 0))


def clean_play_hours(raw: DataFrame) -> DataFrame:
    """Plays with hours parsed from text; rows without a number are dropped."""
    parsed = raw.where(_is(PLAY)).withColumn("hours", to_double(F.col("hours").cast("string")))
    return parsed.where(F.col("hours").isNotNull())


def measured_plays(interactions: DataFrame) -> DataFrame:
    return plays(interactions).where(F.col("hours").isNotNull())


def interactions_for_item(interactions: DataFrame, item: str) -> DataFrame:
    return interactions.where(F.col("item") == item)


def effective_hours(interactions: DataFrame) -> DataFrame:
    """Hours of plays; any other row counts as no time."""
    return interactions.withColumn("hours_clean", F.when(_is(PLAY), F.col("hours")).otherwise(0.0))


def user_item_facts(interactions: DataFrame) -> DataFrame:
    """One row per (user, item) with everything the item reports need.

    Distinct users per item become plain sums afterwards, so a popular item is pre-aggregated over
    all its users before anything is shuffled by item.
    """
    return pair_facts(where_keys(interactions, "user_id", "item"))


def pair_facts(interactions: DataFrame) -> DataFrame:
    """The same, with rows for a missing user or item: all of the log in one pass."""
    return interactions.groupBy("user_id", "item").agg(
        count_where(_is(PURCHASE)).alias("purchase_rows"),
        count_where(_is(PLAY)).alias("play_rows"),
        F.count(F.when(_is(PLAY), F.col("hours"))).alias("timed_rows"),
        F.sum(F.when(_is(PLAY), F.col("hours"))).alias("hours_sum"),
        F.sum(F.when(_is(PLAY) & (F.col("hours") > 0), F.col("hours"))).alias("active_hours"),
    )


def total_hours_by_item(interactions: DataFrame) -> DataFrame:
    totals = where_keys(plays(interactions), "item").groupBy("item").agg(F.sum("hours").alias("total_hours"))
    return totals.orderBy(F.desc_nulls_last("total_hours"), "item")


def players_by_item(interactions: DataFrame) -> DataFrame:
    return where_keys(plays(interactions), "item").groupBy("item").agg(
        F.count_distinct("user_id").alias("players"))


def avg_hours_by_item(interactions: DataFrame) -> DataFrame:
    """Mean over play rows, not over users."""
    return where_keys(plays(interactions), "item").groupBy("item").agg(F.avg("hours").alias("avg_hours"))


def hours_by_user(interactions: DataFrame) -> DataFrame:
    return where_keys(plays(interactions), "user_id").groupBy("user_id").agg(
        F.sum("hours").alias("total_hours"))


def avg_hours_per_user(interactions: DataFrame) -> DataFrame:
    return hours_by_user(interactions).agg(F.avg("total_hours").alias("avg_hours_per_user"))


def user_item_hours_max(interactions: DataFrame) -> DataFrame:
    """One value per pair, for logs whose hours are cumulative."""
    return where_keys(measured_plays(interactions), "user_id", "item").groupBy("user_id", "item").agg(
        F.max("hours").alias("hours"))


def user_item_hours_sum(interactions: DataFrame) -> DataFrame:
    return where_keys(plays(interactions), "user_id", "item").groupBy("user_id", "item").agg(
        F.sum("hours").alias("hours"))


def item_usage(interactions: DataFrame) -> DataFrame:
    """Players, hours, hours per player and purchasers of every item that was played."""
    per_item = user_item_facts(known_behavior(interactions)).groupBy("item").agg(
        count_where(F.col("play_rows") > 0).alias("players"),
        F.coalesce(F.sum("hours_sum"), F.lit(0.0)).alias("total_hours"),
        count_where(F.col("purchase_rows") > 0).alias("purchasers"),
    )
    return per_item.where(F.col("players") > 0).select(
        "item", "players", "total_hours",
        ratio(F.col("total_hours"), F.col("players")).alias("avg_hours_per_player"), "purchasers")


def owners_by_item(interactions: DataFrame) -> DataFrame:
    return where_keys(purchases(interactions), "item").groupBy("item").agg(
        F.count_distinct("user_id").alias("owners"))


def entries_by_item(interactions: DataFrame) -> DataFrame:
    """Rows per item, repeated users included."""
    return where_keys(interactions, "item").groupBy("item").agg(F.count("*").alias("entries"))


def item_feature_table(interactions: DataFrame) -> DataFrame:
    return where_keys(plays(interactions), "item").groupBy("item").agg(
        F.count_distinct("user_id").alias("num_players"),
        F.avg("hours").alias("avg_hours"),
        F.coalesce(F.sum("hours"), F.lit(0.0)).alias("total_hours"),
    )


def owner_pairs(interactions: DataFrame) -> DataFrame:
    return purchases(interactions).select("user_id", "item").distinct()


def user_collector_stats(interactions: DataFrame) -> DataFrame:
    """Per user: items owned and hours played, 0 where there is none of either."""
    per_user = user_item_facts(interactions).groupBy("user_id").agg(
        count_where(F.col("purchase_rows") > 0).alias("owned_items"),
        F.coalesce(F.sum("active_hours"), F.lit(0.0)).alias("total_hours"),
        F.max(flag(F.col("active_hours").isNotNull())).alias("_active"),
    )
    return per_user.where((F.col("owned_items") > 0) | (F.col("_active") > 0)).drop("_active")


def top_items_by_players(interactions: DataFrame, n: int = 20) -> DataFrame:
    return top(players_by_item(interactions), n, F.desc("players"), "item")


def top_items_by_hours(interactions: DataFrame, n: int = 20) -> DataFrame:
    return total_hours_by_item(interactions).limit(n)
