"""Groups of alike items: K-means with the usual checks on k, and principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.features import ITEM_FEATURES, assembled, centered
from usagelens.operators.silhouette import silhouette_score
from usagelens.session import materialize

SEED = 42
MAX_ITER = 300


def fitted_kmeans(vectors: DataFrame, k: int, seed: int = SEED, column: str = "cluster", max_iter: int = MAX_ITER) -> KMeansModel:
    """K-means that has come to rest; an error if it has not after `max_iter` steps."""
    model = KMeans(k=k, seed=seed, predictionCol=column, maxIter=max_iter).fit(vectors)
    if model.summary.numIter >= max_iter:
        raise RuntimeError(f"clusters did not settle in {max_iter} steps")
    return model


def _per_k(scaled: DataFrame, columns: Sequence[str], ks: Iterable[int], seed: int, parallelism: int,
           measures: dict[str, Callable]) -> DataFrame:
    """Fit one model per k and measure it; only the measured numbers come to the driver.

    The fits are independent, so several run at once and fill each other's gaps.
    """
    spark = scaled.sparkSession
    vectors = assembled(materialize(scaled), columns).select("features").persist()

    def fit(k: int) -> tuple:
        model = fitted_kmeans(vectors, k, seed)
        return (k, *[float(measure(model, vectors)) for measure in measures.values()])

    try:
        with ThreadPool(parallelism) as pool:
            rows = pool.map(inheritable_thread_target(spark)(fit), list(ks))
    finally:
        vectors.unpersist()
    return spark.createDataFrame(rows, ", ".join(["k int", *[f"{name} double" for name in measures]]))


def _inertia(model: KMeansModel, vectors: DataFrame) -> float:
    return model.summary.trainingCost


def _silhouette(model: KMeansModel, vectors: DataFrame) -> float:
    """Mean silhouette by squared Euclidean distance, which takes one pass and no pairs."""
    return ClusteringEvaluator(predictionCol="cluster").evaluate(model.transform(vectors))


def _euclidean(model: KMeansModel, vectors: DataFrame) -> float:
    """Mean silhouette by Euclidean distance, from all pairs of distinct points, in tiles."""
    points = model.transform(vectors).select("cluster", vector_to_array("features").alias("place"))
    return silhouette_score(points).first()["silhouette"]


def kmeans_sweep(scaled: DataFrame, columns: Sequence[str] = ITEM_FEATURES, ks: Iterable[int] = range(2, 11),
                 seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """Inertia and silhouette per k."""
    return _per_k(scaled, columns, ks, seed, parallelism, {"inertia": _inertia, "silhouette_sq": _silhouette})


def kmeans_elbow(scaled: DataFrame, columns: Sequence[str] = ITEM_FEATURES, ks: Iterable[int] = range(2, 11),
                 seed: int = SEED, parallelism: int = 4) -> DataFrame:
    return _per_k(scaled, columns, ks, seed, parallelism, {"inertia": _inertia})


def kmeans_silhouette(scaled: DataFrame, columns: Sequence[str] = ITEM_FEATURES, ks: Iterable[int] = range(2, 11),
                      seed: int = SEED, parallelism: int = 4) -> DataFrame:
    return _per_k(scaled, columns, ks, seed, parallelism, {"silhouette_sq": _silhouette})


def kmeans_silhouette_euclidean(scaled: DataFrame, columns: Sequence[str] = ITEM_FEATURES, ks: Iterable[int] = range(2, 11),
                                seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """Silhouette per k by plain distance; `kmeans_silhouette` takes the squared one, which needs no pairs."""
    return _per_k(scaled, columns, ks, seed, parallelism, {"silhouette": _euclidean})


def off_centre(vectors: DataFrame, clusters: DataFrame, key: str, columns: Sequence[str], slack: float = 1e-9) -> DataFrame:
    """One row: the points, their clusters, and how many points lie nearer to the centre of another cluster than to their own.

    Centres are the means of the given clusters, so the check needs no model; 0 is what settled K-means leaves. Each point meets
    an array of all centres, one per cluster, and no other point.
    """
    held = materialize(vectors.select(key, F.array(*columns).alias("place")).join(clusters.select(key, "cluster"), key))
    means = [F.avg(F.element_at("place", i + 1)) for i in range(len(columns))]
    centres = held.groupBy("cluster").agg(F.array(*means).alias("centre")).agg(
        F.collect_list(F.struct("cluster", "centre"))).scalar()

    def distance(centre) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(F.col("place"), centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))

    held = held.withColumn("centres", centres)
    reach = F.transform("centres", lambda c: F.struct(distance(c["centre"]).alias("d"), c["cluster"].alias("cluster")))
    own = F.element_at(F.filter(F.col("reach"), lambda r: r["cluster"] == F.col("cluster")), 1)["d"]
    near = held.withColumn("reach", reach).withColumn("off", own > F.array_min("reach")["d"] + slack)
    return near.agg(F.count("*").alias("points"), F.count_distinct("cluster").alias("clusters"),
                    F.count_if("off").alias("off_centre"))


def item_clusters(scaled: DataFrame, columns: Sequence[str] = ITEM_FEATURES, k: int = 4,
                  seed: int = SEED) -> DataFrame:
    """Item and its cluster."""
    vectors = assembled(materialize(scaled), columns)
    model = fitted_kmeans(vectors, k, seed)
    return model.transform(vectors).select("item", "cluster")


def top_items_per_cluster(features: DataFrame, clusters: DataFrame, n: int = 5) -> DataFrame:
    """The n items with most players of each cluster."""
    by_players = Window.partitionBy("cluster").orderBy(F.desc("num_players"), "item")
    ranked = features.join(clusters, "item").withColumn("rank", F.row_number().over(by_players))
    return ranked.where(F.col("rank") <= n).select("cluster", "rank", "item", "num_players")


def _fit_pca(scaled: DataFrame, columns: Sequence[str], k: int):
    vectors = assembled(materialize(centered(scaled, columns)), columns)
    return vectors, PCA(k=k, inputCol="features", outputCol="projected").fit(vectors)


def signs_of(components) -> list[float]:
    """Per component +1 or -1, so that its largest loading comes out positive."""
    return [1.0 if max(column, key=abs) >= 0 else -1.0 for column in components.T]


def item_pca(scaled: DataFrame, columns: Sequence[str] = ITEM_FEATURES, k: int = 2) -> DataFrame:
    """Items on the first k principal components."""
    vectors, model = _fit_pca(scaled, columns, k)
    place = vector_to_array(F.col("projected"))
    signs = signs_of(model.pc.toArray())
    return model.transform(vectors).select(
        "item", *[(place[i] * sign).alias(f"pca{i + 1}") for i, sign in enumerate(signs)])


def item_pca_components(scaled: DataFrame, columns: Sequence[str] = ITEM_FEATURES, k: int = 2) -> DataFrame:
    """Loadings per component and feature, with the share of variance the component explains."""
    _, model = _fit_pca(scaled, columns, k)
    loadings, explained = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [(c + 1, name, float(loadings[f, c] * sign), float(explained[c]))
            for c, sign in enumerate(signs_of(loadings)) for f, name in enumerate(columns)]
    return scaled.sparkSession.createDataFrame(
        rows, "component int, feature string, loading double, explained_ratio double")
