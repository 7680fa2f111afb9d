"""Who owns an item, what owners do with it, and how items rank on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import ordered
from usagelens.functions.frames import stacked, top, where_keys
from usagelens.functions.joins import spread_join
from usagelens.functions.numeric import count_where, ratio
from usagelens.operators.usage import pair_facts, purchases, user_item_facts
from usagelens.schema import PURCHASE
from usagelens.session import materialize

# Weights of the success score.
SUCCESS_WEIGHTS = {"ownership_rate": 0.4, "avg_hours_per_owner": 0.3, "share_played_ge_2h": 0.3}


def total_users(interactions: DataFrame) -> Column:
    """Distinct users of the whole log, as a scalar subquery."""
    return interactions.agg(F.count_distinct("user_id").alias("users")).scalar()


def owner_hours(interactions: DataFrame) -> DataFrame:
    """Every (owner, item) pair with its hours, 0 when never played; plays of non-owners drop out.

    A single aggregation by pair replaces the join of purchases to plays.
    """
    return _hours_of_owners(user_item_facts(interactions))


def _hours_of_owners(facts: DataFrame) -> DataFrame:
    owned = where_keys(facts, "user_id", "item").where(F.col("purchase_rows") > 0)
    return owned.select("user_id", "item", F.coalesce("active_hours", F.lit(0.0)).alias("hours"))


def owner_engagement(interactions: DataFrame) -> DataFrame:
    """Per item: owners, how many play and how long, and shares of all users."""
    facts = materialize(pair_facts(interactions))  # the log is read once, for owners and for all users
    runs = ordered.value_runs(_hours_of_owners(facts), ["item"], "hours")
    n = F.col("n")

    def owners_with(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    owners = F.sum("n")
    per_item = runs.groupBy("item").agg(
        owners.alias("owners"),
        owners_with(F.col("hours") > 0).alias("players"),
        ratio(owners_with(F.col("hours") > 0), owners).alias("share_played"),
        ratio(owners_with(F.col("hours") >= 2), owners).alias("share_played_ge_2h"),
        ratio(owners_with(F.col("hours") >= 3), owners).alias("share_played_ge_3h"),
        ordered.mean_of_runs().alias("avg_hours_per_owner"),
        ordered.percentile_of_runs("hours", 0.5).alias("median_hours_per_owner"),
        F.sum("mass").alias("total_hours"),
    )
    users = total_users(facts)
    zero = F.lit(0.0)
    return per_item.select(
        "*",
        F.coalesce(ratio(F.col("owners"), users), zero).alias("ownership_rate"),
        F.coalesce(ratio(F.col("players"), users), zero).alias("player_rate"),
        F.coalesce(ratio(F.col("players"), F.col("owners")), zero).alias("play_rate"),
    )


def success_scores(engagement: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add the weighted mean-rank score over all items. Metrics tie at nine decimals."""
    weights = weights or SUCCESS_WEIGHTS
    engagement = materialize(engagement)
    rounded = engagement.select("item", *[F.round(c, 9).alias(c) for c in weights])
    long = stacked(rounded, list(weights), keep=["item"])
    shares = ordered.average_rank_shares(long, ["metric"], "value", "rank_share")
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("metric")]
    scores = (spread_join(long, shares, ["metric", "value"], ["item"])
              .groupBy("item").agg(F.sum(weight * F.col("rank_share")).alias("success_score")))
    return engagement.join(scores, "item")


def owner_success_score(interactions: DataFrame, min_owners: int = 20, n: int = 15) -> DataFrame:
    """Best items by success score; ranks run over all items, the owner minimum applies after."""
    scored = success_scores(owner_engagement(interactions)).where(F.col("owners") >= min_owners)
    best = top(scored.withColumn("success_score", F.round("success_score", 9)), n,
               F.desc("success_score"), "item")
    return best.select(
        "item", "owners", F.bround("ownership_rate", 4).alias("ownership_rate"),
        "players", F.bround("player_rate", 4).alias("player_rate"),
        *[F.bround(c, 2).alias(c) for c in ("avg_hours_per_owner", "share_played_ge_2h", "share_played_ge_3h")],
        "success_score")


def top_items_by_activation(interactions: DataFrame, min_owners: int = 20, n: int = 20) -> DataFrame:
    """Items whose owners most often play at all."""
    owned = owner_hours(interactions).groupBy("item").agg(
        F.count("*").alias("owners"), count_where(F.col("hours") > 0).alias("players"))
    shares = owned.where(F.col("owners") >= min_owners).withColumn(
        "share_played", ratio(F.col("players"), F.col("owners")))
    return top(shares, n, F.desc("share_played"), "item")


def non_owners(interactions: DataFrame, item: str) -> DataFrame:
    """Users of the log who did not buy the item."""
    users = interactions.where(F.col("user_id").isNotNull()).select("user_id").distinct()
    owners = purchases(interactions).where(F.col("item") == item).select("user_id").distinct()
    return users.join(owners, "user_id", "left_anti")


def ownership_ratio_item(interactions: DataFrame, item: str) -> DataFrame:
    """Owners per hundred non-owners of one item, cut to a whole number; NULL if all own it."""
    owned = (F.col("behavior") == PURCHASE) & (F.col("item") == item)
    counts = interactions.agg(F.count_distinct("user_id").alias("users"),
                              F.count_distinct(F.when(owned, F.col("user_id"))).alias("owners"))
    others = F.col("users") - F.col("owners")
    return counts.select("owners", others.alias("non_owners"),
                         ratio(F.col("owners") * 100, others).cast("bigint").alias("ratio_percent"))


def ownership_rate_all_users(interactions: DataFrame, n: int = 20) -> DataFrame:
    """Purchase rows per hundred users."""
    facts = materialize(pair_facts(interactions))
    entries = where_keys(facts, "item").groupBy("item").agg(F.sum("purchase_rows").alias("purchase_rows"))
    rates = entries.where(F.col("purchase_rows") > 0).select(
        "item", "purchase_rows", (ratio(F.col("purchase_rows"), total_users(facts)) * 100).alias("ownership_rate"))
    return top(rates, n, F.desc("ownership_rate"), "item")


def ownership_rate_vs_non_owners(interactions: DataFrame) -> DataFrame:
    """Owners per hundred non-owners; NULL (last) for an item everyone owns."""
    facts = materialize(pair_facts(interactions))
    others = total_users(facts) - F.col("owners")
    owners = where_keys(facts, "item").where(F.col("purchase_rows") > 0).groupBy("item").agg(F.count("user_id").alias("owners"))
    rates = owners.select("item", "owners", others.alias("non_owners"))
    return rates.withColumn(
        "ownership_rate", ratio(F.col("owners"), F.col("non_owners")) * 100
    ).orderBy(F.desc_nulls_last("ownership_rate"), "item")


def owner_bubble_points(interactions: DataFrame, min_owners: int = 20) -> DataFrame:
    """Owners against hours per owner, sized by the share that plays two hours."""
    kept = owner_hours(interactions).groupBy("item").agg(
        F.count("*").alias("owners"), F.avg("hours").alias("avg_hours"),
        count_where(F.col("hours") >= 2).alias("_long"))
    return kept.where(F.col("owners") >= min_owners).select(
        F.col("item").alias("label"), F.col("owners").alias("x"), F.col("avg_hours").alias("y"),
        (400 * ratio(F.col("_long"), F.col("owners"))).alias("size"))
