"""One query per operator, over the logs and the catalogue derived from the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.text import clean_title, rating, year_in
from usagelens.operators import catalog as cat
from usagelens.operators import (cluster, distribution, features, neighbors, ownership, profile, retention,
                                 segments, silhouette, usage)
from usagelens.schema import PLAY, PURCHASE
from usagelens.session import materialize, scratch_path
from usagelens.sources import files, shaping
from usagelens.sources.adapters import event_interactions, order_interactions, part_catalog

Query = Callable[[SparkSession, str], DataFrame]

ITEM = "small ring"
TWO_FEATURES = ("num_players", "avg_hours")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal.

    Rounding to nine places first takes away the noise that would decide ties at the last place.
    """
    return df.select(*[F.round(F.round(F.col(f"`{n}`"), 9), digits).alias(n) if t == "double"
                       else F.col(f"`{n}`") for n, t in df.dtypes])


def on_orders(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, folder: rounded(operator(order_interactions(spark, folder), **options))


def on_events(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, folder: rounded(operator(event_interactions(spark, folder), **options))


def on_catalog(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, folder: rounded(operator(cat.shape_catalog(part_catalog(spark, folder)), **options))


def on_join(operator: Callable[..., DataFrame], **options) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        log = order_interactions(spark, folder)
        return rounded(operator(log, cat.shape_catalog(part_catalog(spark, folder)), **options))
    return run


def on_scores(operator: Callable[..., DataFrame], **options) -> Query:
    return on_join(lambda log, catalog: operator(cat.with_scores(cat.join_catalog_exact(log, catalog)), **options))


def on_retention(operator: Callable[..., DataFrame], **options) -> Query:
    return on_orders(lambda log: operator(retention.retention_by_item(log), **options))


def on_scaled(operator: Callable[..., DataFrame], robust: bool = True, columns=features.ITEM_FEATURES,
              **options) -> Query:
    scale = features.robust_scaled_features if robust else features.zscore_features
    return on_orders(lambda log: operator(scale(usage.item_feature_table(log), columns), columns=columns, **options))


def on_part(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: rounded(operator(spark.read.parquet(f"{folder}/part.parquet")))


# Inputs that need some untidiness first.

def misspelled_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Titles starting with s or r get a doubled letter after their blank."""
    catalog = cat.shape_catalog(part_catalog(spark, folder))
    doubled = F.regexp_replace("title_clean", " (.)", " $1$1")
    return catalog.withColumn("title_clean", F.when(F.col("title_clean").rlike("^[sr]"), doubled)
                              .otherwise(F.col("title_clean")))


def on_misspelled(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, folder: rounded(
        operator(order_interactions(spark, folder), misspelled_catalog(spark, folder), **options))


def text_hours(log: DataFrame) -> DataFrame:
    """Hours as text, some of them no numbers."""
    text = F.col("hours").cast("string")
    return log.withColumn("hours", F.when(F.col("user_id") % 7 == 0, "tbd")
                          .when(F.col("user_id") % 7 == 1, F.concat(text, F.lit("d")))
                          .when(F.col("user_id") % 7 == 2, F.concat(F.lit(" "), text, F.lit(" ")))
                          .when(F.col("user_id") % 7 == 3, "").otherwise(text))


def text_parts(part: DataFrame) -> DataFrame:
    """Parts as text: integers, decimal commas, blanks, words and an empty column."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return part.select(
        key.cast("string").alias("code"),
        F.concat(size.cast("string"), F.lit(","), (key % 10).cast("string")).alias("measure"),
        F.when(size % 2 == 0, size.cast("string")).otherwise("").alias("even_size"),
        F.when(key % 5 == 0, size.cast("string")).otherwise(F.col("p_name")).alias("mixed"),
        F.lit("").alias("empty"))


def ragged_lines(part: DataFrame) -> DataFrame:
    """CSV records of two, three or four fields, with quoted commas and quotes."""
    key = F.col("p_partkey").cast("string")
    quoted = F.concat(F.lit('"a ""'), F.col("p_name"), F.lit('"", b"'))
    kind = F.col("p_partkey") % 3
    return part.select(
        F.when(kind == 0, F.concat_ws(",", key, quoted))
        .when(kind == 1, F.concat_ws(",", key, quoted, F.lit("")))
        .otherwise(F.concat_ws(",", key, quoted, F.lit(""), F.col("p_brand"))).alias("value"))


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "interactions")
    files.write_report_csv(order_interactions(spark, folder).withColumn("extra", F.lit(0)), path, header=False)
    return files.scan_interactions(spark, path)


def catalog_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "catalog")
    files.write_report_csv(part_catalog(spark, folder), path)
    return files.scan_catalog(spark, path, keep=("genre", "developer"))


def tolerant_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "catalog")
    untidy = part_catalog(spark, folder).toDF(" Title", "Genre", "Developer", "Meta Score", "User-Score", "Released #")
    files.write_report_csv(untidy, path)
    return files.read_csv_tolerant(spark, path)


def line_break_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that hold a line break."""
    path = scratch_path(spark, "catalog")
    broken = F.concat("title", F.lit("\n"), "genre")
    files.write_report_csv(part_catalog(spark, folder).withColumn("title", broken), path)
    return files.scan_catalog(spark, path, keep=("developer",))


def of_last_user(operator: Callable[..., DataFrame]) -> Query:
    """For the user with the greatest id in place of the first."""
    return on_events(lambda log: operator(log, user_id=log.agg(F.max("user_id")).first()[0]))


def decoded_items(log: DataFrame) -> DataFrame:
    codes = neighbors.encode_items(log)
    return neighbors.decode_items(codes.select("item_code"), codes)


def report_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "report")
    files.write_report_csv(usage.top_items_by_hours(order_interactions(spark, folder)), path)
    return spark.read.csv(path, header=True, schema="item string, total_hours double")


def batch_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "batches")
    files.write_batches(shaping.cast_inferred_types(text_parts(spark.read.parquet(f"{folder}/part.parquet"))), path)
    return rounded(spark.read.parquet(path))


def raw_join_profile(log: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """Non-null values per column of the row-level join."""
    return cat.join_catalog_raw_profile(log, catalog, how)


def raw_join_rows(log: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """All rows of the row-level join: their number, how many found a title, and a sum over all columns that no order changes.

    A log row meets many titles, so its columns become text once, before the join; a joined row only adds
    genre and developer.
    """
    cents = F.round(F.col("hours") * 100).cast("bigint")
    some = F.coalesce(*[c.cast("string") for c in (F.col("user_id"), F.col("item"), F.col("behavior"), cents)]).isNotNull()
    rows = log.withColumn("_row", F.when(some, F.concat_ws("|", "user_id", "item", "behavior", cents)))
    joined = cat.join_catalog_raw(rows, catalog, how)
    row = F.concat_ws("|", "_row", F.coalesce("genre", F.lit("-")), F.coalesce("developer", F.lit("-")))
    return joined.agg(F.count("*").alias("entries"), F.count("genre").alias("matched"),
                      F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")).alias("checksum"))


def item_top_per_cluster(log: DataFrame) -> DataFrame:
    table = materialize(usage.item_feature_table(log))
    return cluster.top_items_per_cluster(table, cluster.item_clusters(features.robust_scaled_features(table)))


def tiered_points(log: DataFrame) -> DataFrame:
    """Items by their scaled features, grouped by how often they were played: below, at and above the mean."""
    scaled = materialize(features.zscore_features(usage.item_feature_table(log)))
    tier = F.when(F.col("num_players") < -0.5, 0).when(F.col("num_players") < 0.5, 1).otherwise(2)
    return scaled.select("item", tier.alias("cluster"), F.array(*features.ITEM_FEATURES).alias("place"))


def settled_items(scaled: DataFrame, columns=features.ITEM_FEATURES, k: int = 4) -> DataFrame:
    """How many items lie off the centre of the cluster that K-means gave them."""
    scaled = materialize(scaled)
    return cluster.off_centre(scaled, cluster.item_clusters(scaled, columns, k), "item", columns)


def _source_queries() -> dict[str, Query]:
    return {
        "scan_interactions": csv_round_trip,
        "scan_catalog": catalog_round_trip,
        "scan_catalog_line_breaks": line_break_round_trip,
        "read_csv_tolerant": tolerant_round_trip,
        "preview": on_part(lambda p: files.preview(p.orderBy("p_partkey"))),
        "write_report_csv": report_round_trip,
        "write_batches": batch_round_trip,
        "normalize_column_names": on_part(lambda p: shaping.normalize_column_names(
            p.select("p_partkey", "p_name", "p_size", "p_brand", "p_type", "p_retailprice").toDF(
                " Part  Key", "Name #", "Size %", "Brand-Name", "Type", "Retail Price"))),
        "sanitize_column_names": on_part(lambda p: shaping.sanitize_column_names(
            p.select("p_partkey", "p_name", "p_size", "p_brand", "p_type", "p_retailprice").toDF(
                "part key", "part-key", "9 size", "!!", "type", "price"))),
        "infer_column_types": on_part(lambda p: shaping.infer_column_types(text_parts(p))),
        "cast_inferred_types": on_part(lambda p: shaping.cast_inferred_types(text_parts(p))),
        "pad_ragged_rows": on_part(lambda p: shaping.pad_ragged_rows(ragged_lines(p))),
        "positional_table": on_part(lambda p: shaping.positional_table(p.select("p_partkey", "p_name", "p_size"))),
    }


def _profile_queries() -> dict[str, Query]:
    return {
        "profile_columns": on_catalog(profile.profile_columns),
        "describe_numeric": on_orders(profile.describe_numeric),
        "null_counts": on_catalog(profile.null_counts),
        "distinct_counts": on_orders(profile.distinct_counts),
        "distinct_items": on_orders(profile.distinct_items),
        "behavior_counts": on_orders(profile.behavior_counts),
        "correlation_matrix": on_orders(lambda log: profile.correlation_matrix(log.withColumn("extra", F.lit(0)))),
        "correlation_matrix_scores": on_scores(profile.correlation_matrix),
    }


def _usage_queries() -> dict[str, Query]:
    return {
        "plays": lambda spark, folder: rounded(usage.plays(order_interactions(spark, folder, PLAY))),
        "purchases": lambda spark, folder: rounded(usage.purchases(order_interactions(spark, folder, PURCHASE))),
        "active_plays": on_events(usage.active_plays),
        "clean_play_hours": on_orders(lambda log: usage.clean_play_hours(text_hours(log))),
        "interactions_for_item": on_orders(usage.interactions_for_item, item=ITEM),
        "effective_hours": on_orders(usage.effective_hours),
        "total_hours_by_item": on_orders(usage.total_hours_by_item),
        "players_by_item": on_orders(usage.players_by_item),
        "avg_hours_by_item": on_orders(usage.avg_hours_by_item),
        "hours_by_user": on_orders(usage.hours_by_user),
        "avg_hours_per_user": on_orders(usage.avg_hours_per_user),
        "user_item_hours_max": on_orders(usage.user_item_hours_max),
        "user_item_hours_sum": on_orders(usage.user_item_hours_sum),
        "item_usage": on_orders(usage.item_usage),
        "owners_by_item": on_orders(usage.owners_by_item),
        "entries_by_item": on_orders(usage.entries_by_item),
        "item_feature_table": on_orders(usage.item_feature_table),
        "owner_pairs": on_orders(usage.owner_pairs),
        "user_collector_stats": on_orders(usage.user_collector_stats),
        "top_items_by_players": on_orders(usage.top_items_by_players),
        "top_items_by_hours": on_orders(usage.top_items_by_hours),
    }


def _segment_queries() -> dict[str, Query]:
    return {
        "tester_stayer_all_rows": on_orders(segments.tester_stayer_all_rows),
        "tester_stayer_3h": on_orders(segments.tester_stayer_3h),
        "tester_stayer_3h_top30": on_orders(segments.tester_stayer_3h, n=30),
        "bucket_share_strict": on_events(segments.bucket_share_strict),
        "bucket_share_strict_empty_side": on_orders(segments.bucket_share_strict),
        "bucket_share_min_entries": on_orders(segments.bucket_share_min_entries),
        "success_score_stayers": on_orders(segments.success_score_stayers),
        "ownership_ratio_item": on_orders(ownership.ownership_ratio_item, item=ITEM),
        "ownership_rate_all_users": on_orders(ownership.ownership_rate_all_users),
        "ownership_rate_vs_non_owners": on_orders(ownership.ownership_rate_vs_non_owners),
        "non_owners": on_orders(ownership.non_owners, item=ITEM),
        "owner_hours": on_orders(ownership.owner_hours),
        "owner_engagement": on_orders(ownership.owner_engagement),
        "owner_success_score": on_orders(ownership.owner_success_score),
        "top_items_by_activation": on_orders(ownership.top_items_by_activation),
        "bubble_points": on_orders(ownership.owner_bubble_points),
    }


def _retention_queries() -> dict[str, Query]:
    return {
        "retention_by_item": on_orders(retention.retention_by_item),
        "retention_category": on_retention(retention.retention_category),
        "retention_category_90": on_retention(retention.retention_category, high=90),
        "retention_medians": on_retention(retention.retention_medians),
        "retention_trend": on_retention(retention.retention_trend),
        "retention_quadrants": on_retention(retention.retention_quadrant_counts),
        "retention_quadrants_by_item": on_retention(retention.retention_quadrants),
        "high_playtime_items": on_events(lambda log: retention.high_playtime_items(
            retention.retention_by_item(log, min_buyers=5), min_avg_hours=50)),
        "bubble_points_retention": on_retention(retention.retention_bubble_points),
    }


def _distribution_queries() -> dict[str, Query]:
    return {
        "mean_vs_median_by_item": on_orders(distribution.mean_vs_median_by_item),
        "mean_vs_median_by_item_events": on_events(distribution.mean_vs_median_by_item, min_players=5),
        "top_mean_median_gap": on_orders(distribution.top_mean_median_gap),
        "bubble_points_mean_median": on_orders(distribution.mean_median_bubble_points),
        "tail_percentiles_by_item": on_events(distribution.tail_percentiles_by_item, min_players=5),
        "gini_by_item": on_events(distribution.gini_by_item),
        "gini_users": on_events(distribution.gini_users),
        "lorenz_top_items": on_events(distribution.lorenz_top_items),
        "lorenz_users": on_events(distribution.lorenz_users),
        "hours_histogram_by_item": on_events(distribution.hours_histogram_by_item),
        "hours_histogram_users": on_events(distribution.hours_histogram_users),
        "hours_boxstats_by_item": on_events(distribution.hours_boxstats_by_item),
        "log_hours_boxstats_by_item": on_events(distribution.log_hours_boxstats_by_item),
    }


def _catalog_queries() -> dict[str, Query]:
    usage_with_genre = cat.join_catalog_left
    scores = ("item", "title", "genre", "release_year", "metascore", "userscore")

    def genre_list(measure: str) -> Query:
        return on_join(lambda log, c: cat.top_genres(cat.genre_usage(usage_with_genre(log, c)), measure))

    def best(score: str) -> Query:
        return on_join(lambda log, c: cat.top_by_score(cat.score_report(cat.join_catalog_exact(log, c)), score))

    return {
        "clean_titles": lambda spark, folder: part_catalog(spark, folder).select(
            "title", clean_title(F.col("title")).alias("title_clean"),
            clean_title(F.col("title"), strict=True).alias("title_strict")),
        "coerce_rating": lambda spark, folder: part_catalog(spark, folder).select(
            "title", *[rating(F.col(c)).alias(c) for c in ("metascore", "userscore")]),
        "release_year": lambda spark, folder: part_catalog(spark, folder).select(
            "title", year_in(F.col("release_date")).alias("release_year")),
        "detect_title_column": lambda spark, folder: cat.richest_text_column(
            part_catalog(spark, folder).withColumnRenamed("title", "label")),
        "detect_title_column_named": lambda spark, folder: part_catalog(spark, folder).select(
            F.lit(cat.detect_title_column(part_catalog(spark, folder))).alias("column_name")).distinct(),
        "join_catalog_exact": on_join(cat.join_catalog_exact),
        "join_catalog_left": on_join(cat.join_catalog_left),
        "join_catalog_raw": on_join(raw_join_profile),
        "join_catalog_raw_left": on_join(raw_join_profile, how="left"),
        "join_catalog_raw_rows": on_join(raw_join_rows),
        "join_catalog_raw_left_rows": on_join(raw_join_rows, how="left"),
        "join_catalog_raw_groups": on_join(cat.join_catalog_raw_groups),
        "unmatched_items": on_misspelled(cat.unmatched_items),
        "join_catalog_fuzzy": on_misspelled(cat.join_catalog_fuzzy),
        "engagement_score": on_scores(lambda s: s.select(*scores, "avg_hours", "engagement_score")),
        "quality_score": on_scores(lambda s: s.select(*scores, "quality_score")),
        "top_engagement": best("engagement_score"),
        "top_quality": best("quality_score"),
        "genre_scores": on_scores(cat.genre_scores),
        "scores_by_year": on_scores(cat.scores_by_year),
        "genre_usage": on_join(lambda log, c: cat.genre_usage(usage_with_genre(log, c))),
        "genre_usage_by_players": genre_list("total_players"),
        "genre_usage_by_hours_per_player": genre_list("avg_hours_per_player"),
        "genre_usage_by_purchase_ratio": genre_list("purchase_ratio"),
        "bubble_points_usage": on_orders(lambda log: cat.usage_bubble_points(usage.item_usage(log))),
        "insights_summary": on_join(lambda log, c: cat.insights_summary(
            rounded(cat.score_report(cat.join_catalog_exact(log, c))))),
    }


def _model_queries() -> dict[str, Query]:
    return {
        "encode_items": on_orders(neighbors.encode_items),
        "user_item_matrix": on_orders(neighbors.user_item_matrix),
        "zscore_features": on_orders(lambda log: features.zscore_features(usage.item_feature_table(log))),
        "robust_scaled_features": on_orders(
            lambda log: features.robust_scaled_features(usage.item_feature_table(log))),
        "robust_scaled_features_two": on_orders(
            lambda log: features.robust_scaled_features(usage.item_feature_table(log), TWO_FEATURES)),
        "kmeans_elbow": on_scaled(cluster.kmeans_elbow),
        "kmeans_silhouette": on_scaled(cluster.kmeans_silhouette, columns=TWO_FEATURES),
        "kmeans_silhouette_euclidean": on_scaled(cluster.kmeans_silhouette_euclidean, columns=TWO_FEATURES),
        "silhouette_score": on_orders(lambda log: silhouette.silhouette_score(tiered_points(log))),
        "silhouette_by_cluster": on_orders(lambda log: silhouette.silhouette_by_cluster(tiered_points(log))),
        "item_clusters_settled": on_scaled(settled_items),
        "item_clusters_zscore_settled": on_scaled(settled_items, robust=False, k=10),
        "item_clusters": on_scaled(cluster.item_clusters),
        "item_clusters_zscore": on_scaled(cluster.item_clusters, robust=False, k=10),
        "top_items_per_cluster": on_orders(item_top_per_cluster),
        "item_pca": on_scaled(cluster.item_pca),
        "item_pca_components": on_scaled(cluster.item_pca_components, robust=False),
        "user_clusters": on_events(neighbors.user_clusters),
        "user_pca": on_events(neighbors.user_pca),
        "similar_users": on_events(neighbors.similar_users),
        "recommend_items": on_events(neighbors.recommend_items),
        "similar_users_given": of_last_user(neighbors.similar_users),
        "recommend_items_given": of_last_user(neighbors.recommend_items),
        "decode_items": on_orders(decoded_items),
    }


def queries() -> dict[str, Query]:
    return {**_usage_queries(), **_segment_queries(), **_retention_queries(), **_distribution_queries(),
            **_catalog_queries(), **_source_queries(), **_profile_queries(), **_model_queries()}
