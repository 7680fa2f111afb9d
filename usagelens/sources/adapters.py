"""Interaction logs and a catalogue derived from star-schema tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.numeric import nan_to_null
from usagelens.schema import PLAY, PURCHASE


def as_interactions(df: DataFrame, user_id: str, item: str, behavior: str, hours: str) -> DataFrame:
    """Any log table to the column names and types of this package; NaN hours become NULL."""
    return df.select(F.col(user_id).cast("bigint").alias("user_id"), F.col(item).cast("string").alias("item"),
                     F.col(behavior).cast("string").alias("behavior"),
                     nan_to_null(F.col(hours).cast("double")).alias("hours"))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_interactions(spark: SparkSession, folder: str, behavior: str | None = None) -> DataFrame:
    """Every order line is a purchase; lines that were not returned are also plays of that many hours.

    One row per line is joined, then split into its one or two log rows. `behavior` keeps rows of one kind only, before
    the joins.
    """
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    if behavior == PLAY:
        lines = lines.where(F.col("l_returnflag") != "R")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = _table(spark, folder, "part").select("p_partkey", "p_name")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(
        parts, lines["l_partkey"] == parts["p_partkey"])
    bought = F.struct(F.lit(PURCHASE).alias("behavior"), F.lit(1.0).alias("hours"))
    played = F.struct(F.lit(PLAY).alias("behavior"), F.col("l_quantity").alias("hours"))
    events = {PURCHASE: F.array(bought), PLAY: F.array(played)}.get(
        behavior, F.when(F.col("l_returnflag") != "R", F.array(bought, played)).otherwise(F.array(bought)))
    return as_interactions(joined.select("o_custkey", "p_name", F.inline(events)),
                           "o_custkey", "p_name", "behavior", "hours")


def event_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases, and views and clicks as plays, with heavy-tailed hours."""
    events = _table(spark, folder, "events").where(F.col("event_type").isin("purchase", "view", "click"))
    named = events.select(
        "user_id", F.get_json_object("props", "$.k").alias("item"), "value",
        F.when(F.col("event_type") == "purchase", PURCHASE).otherwise(PLAY).alias("behavior"))
    return as_interactions(named, "user_id", "item", "behavior", "value")


def part_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Raw catalogue, one row per part: untidy titles, scores and dates as text."""
    key, name = F.col("p_partkey"), F.col("p_name")
    return _table(spark, folder, "part").select(
        F.when(key % 3 == 0, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
        .when(key % 3 == 1, F.concat(name, F.lit("™"))).otherwise(name).alias("title"),
        F.col("p_type").alias("genre"), F.col("p_brand").alias("developer"),
        F.when(key % 10 == 0, "tbd").otherwise((F.col("p_size") * 2).cast("string")).alias("metascore"),
        F.replace((F.col("p_size") / 5.0).cast("string"), F.lit("."), F.lit(",")).alias("userscore"),
        F.concat(F.lit("Released "), (1990 + key % 30).cast("string")).alias("release_date"))
