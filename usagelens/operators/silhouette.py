"""Silhouettes by Euclidean distance, in tiles.

Unlike the squared distance, the distance itself has no closed form of sums, so every point meets every other one once.
Points are packed into blocks of about `BLOCK` rows, and a tile is one block against another: 8 MB of distances inside one
task, of which only sums per point and cluster leave. Equal points of a cluster are one row with a weight, so a value that a
third of the points share costs no more than one point. Work grows with the square of the distinct points, as the measure asks;
what moves is each block once per other block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.session import materialize

BLOCK = 1024


def _block(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Point numbers, clusters, weights and places of one block."""
    flat = rows.flatten()
    ids, clusters, weights, places = (flat.field(name) for name in ("id", "cluster", "weight", "place"))
    return (ids.to_numpy(), clusters.to_numpy(), weights.to_numpy().astype(float),
            places.flatten().to_numpy().reshape(len(flat), -1))


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, cluster, total): weighted distances of each point of the left block to the clusters of the right one."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, _, _, here = _block(batch.column("left").slice(row, 1))
            _, clusters, weights, there = _block(batch.column("right").slice(row, 1))
            squares = np.zeros((len(here), len(there)))
            for axis in range(here.shape[1]):
                squares += np.subtract.outer(here[:, axis], there[:, axis]) ** 2
            names, code = np.unique(clusters, return_inverse=True)
            member = np.zeros((len(there), len(names)))
            member[np.arange(len(there)), code] = weights
            totals = np.sqrt(squares) @ member
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, len(names))), pa.array(np.tile(names, len(ids)).astype(np.int32)), pa.array(totals.ravel())],
                ["id", "cluster", "total"])


def weighted_points(points: DataFrame, place: str = "place", cluster: str = "cluster") -> DataFrame:
    """Distinct points: id, cluster, weight (rows that are equal) and place."""
    counted = points.select(F.col(cluster).cast("int").alias("cluster"), F.col(place).alias("place")).groupBy(
        "cluster", "place").agg(F.count("*").alias("weight"))
    return counted.withColumn("id", F.monotonically_increasing_id())


def point_silhouettes(points: DataFrame, place: str = "place", cluster: str = "cluster", block: int = BLOCK) -> DataFrame:
    """Rows (cluster, place, weight, silhouette), one per distinct point of `points` (an array of numbers and a cluster).

    (b - a) / max(a, b), with a the mean distance to the rest of the own cluster and b the least mean distance to another one.
    0 for the only point of a cluster, and where a and b are 0. Without a second cluster there is no silhouette: NULL.
    Rows without place or cluster are left out.
    """
    points = points.where(F.col(place).isNotNull() & F.col(cluster).isNotNull())
    held = materialize(weighted_points(points, place, cluster))
    number = max(1, -(-held.count() // block))
    packed = materialize(held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")).groupBy("block").agg(
        F.collect_list(F.struct("id", "cluster", "weight", "place")).alias("points")))
    # Blocks meet by the number of the left one; many tasks, since a tile is much work for few rows.
    others = packed.select(F.col("points").alias("right"), F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("block"))
    tiles = others.join(packed.select("block", F.col("points").alias("left")), "block").select("left", "right")
    sums = tiles.mapInArrow(_tile_sums, "id long, cluster int, total double").groupBy("id", "cluster").agg(F.sum("total").alias("total"))
    sizes = held.groupBy("cluster").agg(F.sum("weight").alias("members"))
    own = F.col("cluster") == F.col("own")
    # The point itself adds no distance to its own cluster, but counts among its members.
    mean = F.when(own, F.try_divide(F.col("total"), F.col("members") - 1)).otherwise(F.col("total") / F.col("members"))
    ends = sums.join(sizes, "cluster").join(held.select("id", F.col("cluster").alias("own"), "weight"), "id").withColumn("mean", mean)
    judged = ends.groupBy("id").agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"),
                                    F.max(F.when(own, F.col("members"))).alias("members"))
    value = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("members") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return held.join(judged.select("id", value.alias("silhouette")), "id").select("cluster", "place", "weight", "silhouette")


def silhouette_by_cluster(points: DataFrame, place: str = "place", cluster: str = "cluster", block: int = BLOCK) -> DataFrame:
    """Cluster, its members and their mean silhouette."""
    weighted = F.sum(F.col("silhouette") * F.col("weight"))
    return point_silhouettes(points, place, cluster, block).groupBy("cluster").agg(
        F.sum("weight").alias("members"), (weighted / F.sum("weight")).alias("silhouette"))


def silhouette_score(points: DataFrame, place: str = "place", cluster: str = "cluster", block: int = BLOCK) -> DataFrame:
    """One row: the points and their mean silhouette."""
    weighted = F.sum(F.col("silhouette") * F.col("weight"))
    return point_silhouettes(points, place, cluster, block).agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("points"), F.try_divide(weighted, F.sum("weight")).alias("silhouette"))
