"""Users by what they play: the user-item matrix, alike users, recommendations, user groups.

The matrix stays in long form, one row per (user, item) that occurs. Standardising it would make it
dense, since every missing cell becomes -mean/deviation. All results below come from sums over the
cells that exist plus per-item totals, so the dense matrix is never built. The cells, far fewer than
log rows, are written to the shared folder once per query, since every step reads them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import ordered
from usagelens.functions.frames import top, where_keys
from usagelens.functions.joins import spread_join
from usagelens.functions.numeric import ratio
from usagelens.operators.cluster import SEED, fitted_kmeans
from usagelens.operators.features import sparse_vectors
from usagelens.operators.usage import effective_hours
from usagelens.operators.wide_pca import wide_projection
from usagelens.session import materialize


def encode_items(interactions: DataFrame) -> DataFrame:
    """Items in sorted order with their number, from 0."""
    return ordered.dense_codes(interactions, "item", "item_code")


def decode_items(coded: DataFrame, codes: DataFrame) -> DataFrame:
    """Item names back from their numbers, with the frame `encode_items` gave."""
    return coded.join(codes, "item_code", "left")


def user_item_matrix(interactions: DataFrame) -> DataFrame:
    """Mean effective hours per (user, item). Purchases count as 0 hours, so a pair that was bought
    once and played once holds half its hours."""
    cells = where_keys(effective_hours(interactions), "user_id", "item").groupBy("user_id", "item").agg(
        F.avg("hours_clean").alias("hours"))
    return cells.where(F.col("hours").isNotNull())


def item_moments(matrix: DataFrame) -> DataFrame:
    """Mean and variance of each matrix column over all users, missing cells taken as 0.

    Columns without variance are left out: standardised they are 0 for everybody.
    """
    users = matrix.agg(F.count_distinct("user_id").alias("users")).scalar()
    sums = matrix.groupBy("item").agg(F.sum("hours").alias("s1"),
                                      F.sum(F.col("hours") * F.col("hours")).alias("s2"))
    moments = sums.withColumn("mean", F.col("s1") / users).withColumn(
        "variance", F.col("s2") / users - F.col("mean") * F.col("mean"))
    return moments.where(F.col("variance") > F.col("mean") * F.col("mean") * 1e-12).select(
        "item", "mean", "variance")


def _query_user(matrix: DataFrame, user_id: int | None) -> Column:
    """The given user, or the first one of the matrix."""
    return F.lit(user_id) if user_id is not None else matrix.agg(F.min("user_id")).scalar()


def _nearest(matrix: DataFrame, query: Column, n: int) -> DataFrame:
    """The n users nearest to the query user by cosine of standardised rows.

    With z the standardised rows: z_u·z_q = Σ x_u x_q/σ² - b_u - b_q + c and |z_u|² = Σ x_u²/σ² - 2 b_u + c,
    where b_u = Σ x_u μ/σ² and c = Σ μ²/σ². One pass over the cells serves all users.
    """
    own = matrix.where(F.col("user_id") == query).select("item", F.col("hours").alias("own"))
    items = materialize(item_moments(matrix).join(own, "item", "left")
                        .withColumn("own", F.coalesce("own", F.lit(0.0))))
    hours, own, mean, variance = (F.col(c) for c in ("hours", "own", "mean", "variance"))

    def total(term: Column) -> Column:
        return F.coalesce(F.sum(term), F.lit(0.0))

    totals = items.agg(F.struct(total(mean * mean / variance).alias("c"),
                                total(own * mean / variance).alias("b"),
                                total(own * own / variance).alias("xx"))).scalar()
    per_user = spread_join(matrix, items, ["item"], ["user_id"], how="left").groupBy("user_id").agg(
        total(hours * own / variance).alias("dot"),
        total(hours * hours / variance).alias("xx"),
        total(hours * mean / variance).alias("b"))
    product = F.col("dot") - F.col("b") - totals["b"] + totals["c"]
    norms = F.sqrt(F.greatest(F.col("xx") - 2 * F.col("b") + totals["c"], F.lit(0.0))
                   * F.greatest(totals["xx"] - 2 * totals["b"] + totals["c"], F.lit(0.0)))
    # A user the matrix does not know has no neighbours.
    known = matrix.agg(F.max(F.col("user_id") == query)).scalar()
    scored = per_user.where((F.col("user_id") != query) & known).select(
        F.col("user_id").alias("neighbor_id"),
        F.round(F.coalesce(ratio(product, norms), F.lit(0.0)), 9).alias("similarity"))
    return top(scored, n, F.desc("similarity"), "neighbor_id")


def similar_users(interactions: DataFrame, user_id: int | None = None, n: int = 4) -> DataFrame:
    """The n users nearest to one user, by default to the first; the lower id wins a tie. None for an unknown user."""
    matrix = materialize(user_item_matrix(interactions))
    return _nearest(matrix, _query_user(matrix, user_id), n)


def recommend_items(interactions: DataFrame, user_id: int | None = None, n: int = 4) -> DataFrame:
    """Items any of the nearest users played and the user did not; owned but unplayed ones included."""
    matrix = materialize(user_item_matrix(interactions))
    query = _query_user(matrix, user_id)
    near = _nearest(matrix, query, n).select(F.col("neighbor_id").alias("user_id"))
    played = matrix.where(F.col("hours") > 0)
    own = played.where(F.col("user_id") == query).select("item")
    theirs = played.join(near, "user_id", "left_semi").select("item").distinct()
    return theirs.join(own, "item", "left_anti")


def scaled_cells(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matrix cells over their column's deviation, and the columns (item, item_code, center).

    Cells of a column without variance stay, as 0, so that no user gets lost. Cells are not centred.
    """
    matrix = materialize(user_item_matrix(interactions))
    moments = materialize(item_moments(matrix))
    columns = materialize(ordered.dense_codes(moments, "item", "item_code").join(moments, "item"))
    cells = spread_join(matrix, columns, ["item"], ["user_id"], how="left").select(
        "user_id", "item", "item_code",
        F.coalesce(F.col("hours") / F.sqrt("variance"), F.lit(0.0)).alias("scaled"))
    return cells, columns.select("item", "item_code", (F.col("mean") / F.sqrt("variance")).alias("center"))


def _vectors(cells: DataFrame, width: int) -> DataFrame:
    return materialize(sparse_vectors(cells, "user_id", "item_code", "scaled", F.lit(width)))


def user_clusters(interactions: DataFrame, k: int = 3, seed: int = SEED) -> DataFrame:
    """User and cluster, by K-means on standardised rows. Distances do not depend on centring."""
    cells, columns = scaled_cells(interactions)
    vectors = _vectors(cells, columns.count())
    return fitted_kmeans(vectors, k, seed).transform(vectors).select("user_id", "cluster")


def user_pca(interactions: DataFrame, k: int = 2, **options) -> DataFrame:
    """Users on the first k principal components of the standardised matrix, whatever its width."""
    cells, columns = scaled_cells(interactions)
    return wide_projection(materialize(cells), columns, k, **options)
