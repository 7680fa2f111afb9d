"""Splits of an item's users at an hours limit.

The variants differ on purpose in which rows they read and on which side the limit itself falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.frames import top, where_keys
from usagelens.functions.numeric import count_where, ratio
from usagelens.operators.usage import measured_plays


def split_counts(rows: DataFrame, over: Column, under: Column, over_name: str, under_name: str) -> DataFrame:
    """Rows per item on either side of a limit; a side nobody is on counts 0."""
    counts = where_keys(rows, "item").groupBy("item").agg(
        count_where(over).alias(over_name), count_where(under).alias(under_name))
    return counts.withColumn("total", F.col(over_name) + F.col(under_name))


def _shares(counts: DataFrame, over: str, under: str) -> DataFrame:
    return counts.select(
        "*",
        F.coalesce(ratio(F.col(over), F.col("total")), F.lit(0.0)).alias(f"{over}_share"),
        F.coalesce(ratio(F.col(under), F.col("total")), F.lit(0.0)).alias(f"{under}_share"))


def tester_stayer_all_rows(interactions: DataFrame, limit: float = 3, n: int = 20) -> DataFrame:
    """All rows, purchases too: below the limit is a tester, anything else (also no hours) a stayer."""
    tester = F.coalesce(F.col("hours") < limit, F.lit(False))
    counts = split_counts(interactions.where(F.col("user_id").isNotNull()), ~tester, tester,
                          "stayer", "tester")
    shares = counts.withColumn("stayer_percent", ratio(F.col("stayer"), F.col("total")) * 100)
    return top(shares, n, F.desc("stayer_percent"), "item")


def tester_stayer_counts(interactions: DataFrame, limit: float = 3) -> DataFrame:
    """Plays: more than the limit stays, the limit itself still tests."""
    hours = F.col("hours")
    return split_counts(measured_plays(interactions), hours > limit, hours <= limit, "stayers", "testers")


def tester_stayer_3h(interactions: DataFrame, limit: float = 3, n: int = 20) -> DataFrame:
    """The n items with most plays, ordered by the share of stayers."""
    largest = top(tester_stayer_counts(interactions, limit), n, F.desc("total"), "item")
    return _shares(largest, "stayers", "testers").orderBy(F.desc("stayers_share"), "item")


def success_score_stayers(interactions: DataFrame, limit: float = 3, n: int = 20) -> DataFrame:
    """Plays times share of stayers."""
    counts = tester_stayer_counts(interactions, limit)
    stayer_ratio = ratio(F.col("stayers"), F.col("total"))
    scored = counts.withColumn("stayer_ratio", stayer_ratio).withColumn(
        "success_score", F.col("total") * F.col("stayer_ratio"))
    return top(scored, n, F.desc("success_score"), "item")


def bucket_share_strict(interactions: DataFrame, limit: float = 100, n: int = 20) -> DataFrame:
    """Plays off the limit: strictly over against strictly under it."""
    hours = F.col("hours")
    rows = measured_plays(interactions).where(hours != limit)
    largest = top(split_counts(rows, hours > limit, hours < limit, "over", "under"), n,
                  F.desc("over"), F.desc("under"), "item")
    return _shares(largest, "over", "under").orderBy(F.desc("over_share"), F.desc("under_share"), "item")


def bucket_share_min_entries(interactions: DataFrame, limit: float = 10, min_entries: int = 150,
                             n: int = 20) -> DataFrame:
    """Plays of items with enough entries: at or over the limit against under it."""
    hours = F.col("hours")
    counts = split_counts(measured_plays(interactions), hours >= limit, hours < limit, "at_or_over", "under")
    largest = top(counts.where(F.col("total") >= min_entries), n,
                  F.desc("at_or_over"), F.desc("under"), "item")
    return _shares(largest, "at_or_over", "under").orderBy(
        F.desc("at_or_over_share"), F.desc("under_share"), "item")
