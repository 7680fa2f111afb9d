"""Reports of several results that share their costly first steps."""

from __future__ import annotations

from pyspark.sql import DataFrame

from usagelens.operators import catalog as cat
from usagelens.operators import cluster, distribution, features, profile, usage
from usagelens.sources.files import write_insights, write_report_csv
from usagelens.session import materialize


def catalog_report(interactions: DataFrame, raw_catalog: DataFrame, near: bool = True,
                   one_row_per_item: bool = True, n: int = 20) -> dict[str, DataFrame]:
    """Usage joined to the catalogue: scores, best lists, roll-ups, correlations and summary."""
    shaped = cat.shape_catalog(raw_catalog)
    scored = materialize(cat.with_scores(cat.join_catalog_fuzzy(
        interactions, shaped, near=near, one_row_per_item=one_row_per_item)))
    report = scored.select(*cat.REPORT_COLUMNS)
    return {
        "report": report,
        "top_engagement": cat.top_by_score(report, "engagement_score", n),
        "top_quality": cat.top_by_score(report, "quality_score", n),
        "genres": cat.genre_scores(scored),
        "years": cat.scores_by_year(scored),
        "correlations": profile.correlation_matrix(scored),
        "insights": cat.insights_summary(report),
    }


def write_catalog_report(report: dict[str, DataFrame], folder: str) -> None:
    for name in ("top_engagement", "top_quality"):
        write_report_csv(report[name], f"{folder}/{name}")
    write_insights(report["insights"], f"{folder}/insights")


def item_statistics(interactions: DataFrame) -> dict[str, DataFrame]:
    """Mean against median, tails and inequality of hours per item."""
    return {
        "mean_vs_median": distribution.mean_vs_median_by_item(interactions),
        "tails": distribution.tail_percentiles_by_item(interactions),
        "boxes": distribution.log_hours_boxstats_by_item(interactions),
        "lorenz": distribution.lorenz_top_items(interactions),
    }


def item_clustering(interactions: DataFrame, robust: bool = True, k: int = 4,
                    columns: tuple[str, ...] = features.ITEM_FEATURES) -> dict[str, DataFrame]:
    """Scaled item features, the sweep over k, the chosen clusters and their place and best items."""
    table = materialize(usage.item_feature_table(interactions))
    scale = features.robust_scaled_features if robust else features.zscore_features
    scaled = materialize(scale(table, columns))
    clusters = materialize(cluster.item_clusters(scaled, columns, k))
    result = {
        "features": table,
        "sweep": cluster.kmeans_sweep(scaled, columns),
        "clusters": clusters,
        "top_items": cluster.top_items_per_cluster(table, clusters),
    }
    if len(columns) > 2:
        result["projection"] = cluster.item_pca(scaled, columns)
        result["components"] = cluster.item_pca_components(scaled, columns)
    return result
