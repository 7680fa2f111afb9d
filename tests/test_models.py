"""Clusters, components and neighbours, against NumPy on the dense matrix."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SAMPLE, by_key
from usagelens.operators import cluster, features, neighbors, silhouette, usage, wide_pca
from usagelens.sources.adapters import event_interactions


@pytest.fixture(scope="module")
def events(spark):
    return event_interactions(spark, SAMPLE).cache()


@pytest.fixture(scope="module")
def dense(events):
    """Users x items: mean effective hours and their standardised values."""
    data = events.toPandas()
    data["h"] = np.where(data.behavior == "play", data.hours, 0.0)
    table = data.pivot_table(index="user_id", columns="item", values="h", fill_value=0)
    return table, (table - table.mean()) / table.std(ddof=0).replace(0, 1)


@pytest.fixture
def blobs(spark):
    """Two groups of items, far apart on every feature."""
    rng = np.random.default_rng(1)
    rows = [(f"i{g}{i}", *(float(x) for x in rng.normal(10 * g, 1, 3))) for g in (0, 1) for i in range(15)]
    return spark.createDataFrame(rows, "item string, num_players double, avg_hours double, total_hours double")


def test_scaled_features(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "item string, x double, y double")
    z = by_key(features.zscore_features(df, ["x", "y"]))
    assert (z["a"].x, z["b"].x, z["a"].y) == (-1.0, 1.0, 0.0)
    r = by_key(features.robust_scaled_features(df, ["x", "y"]))
    mid, spread = np.median(np.log1p([1, 3])), np.subtract(*np.percentile(np.log1p([1, 3]), [75, 25]))
    assert r["a"].x == pytest.approx((np.log1p(1) - mid) / spread) and r["a"].y == 0


def test_sweep_finds_two_groups(blobs):
    sweep = {r.k: r for r in cluster.kmeans_sweep(blobs, ks=range(2, 5)).collect()}
    assert max(sweep, key=lambda k: sweep[k].silhouette_sq) == 2
    assert sweep[2].silhouette_sq > 0.9 and all(r.inertia >= 0 for r in sweep.values())
    clusters = by_key(cluster.item_clusters(blobs, k=2))
    assert len({clusters[f"i0{i}"].cluster for i in range(15)}) == 1
    assert clusters["i00"].cluster != clusters["i10"].cluster


def _dense_silhouettes(places, groups):
    """Of all points, from the whole distance matrix."""
    distances = np.sqrt(((places[:, None] - places[None]) ** 2).sum(-1))
    values = []
    for i, own in enumerate(groups):
        if (groups == own).sum() == 1:
            values.append(0.0)
            continue
        a = distances[i][groups == own].sum() / ((groups == own).sum() - 1)
        b = min(distances[i][groups == other].mean() for other in set(groups) - {own})
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(values)


@pytest.mark.parametrize("block", [7, 1024])
def test_silhouettes_equal_the_dense_ones(spark, block):
    rng = np.random.default_rng(2)
    places = rng.normal(size=(60, 3)).round(1)
    places[20:45] = places[20]  # a hot value, in two clusters
    groups = rng.integers(0, 3, 60)
    groups[0] = 9  # the only point of its cluster
    points = spark.createDataFrame([(int(g), [float(x) for x in p]) for g, p in zip(groups, places)], "cluster int, place array<double>")
    values = _dense_silhouettes(places, groups)
    score = silhouette.silhouette_score(points, block=block).first()
    assert (score.points, score.silhouette) == (60, pytest.approx(values.mean()))
    parts = by_key(silhouette.silhouette_by_cluster(points, block=block), "cluster")
    assert {c: (r.members, pytest.approx(r.silhouette)) for c, r in parts.items()} == {
        c: (int((groups == c).sum()), values[groups == c].mean()) for c in set(groups.tolist())}


def test_silhouettes_of_no_points_and_of_one_cluster(spark):
    points = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (None, [3.0]), (1, None)], "cluster int, place array<double>")
    assert tuple(silhouette.silhouette_score(points).first()) == (2, None)
    assert tuple(silhouette.silhouette_score(points.limit(0)).first()) == (0, None)


def test_equal_points_are_one_row_of_a_block(spark):
    points = spark.range(500).select((F.col("id") % 2).alias("cluster"), F.array(F.lit(1.0), (F.col("id") % 4).cast("double")).alias("place"))
    held = silhouette.weighted_points(points).collect()
    assert sorted((r.cluster, r.weight) for r in held) == [(0, 125), (0, 125), (1, 125), (1, 125)]


def test_euclidean_sweep(blobs):
    sweep = {r.k: r.silhouette for r in cluster.kmeans_silhouette_euclidean(blobs, ks=range(2, 4)).collect()}
    data = blobs.toPandas().set_index("item")
    expected = _dense_silhouettes(data.to_numpy(), np.array([int(i[1]) for i in data.index]))
    assert sweep[2] == pytest.approx(expected.mean()) and sweep[3] < sweep[2]


def test_off_centre_counts_points_of_the_wrong_cluster(spark):
    places = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 10.0), ("d", 11.0), ("e", 0.5)], "item string, x double")
    right = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 0)], "item string, cluster int")
    assert tuple(cluster.off_centre(places, right, "item", ["x"]).first()) == (5, 2, 0)
    wrong = right.withColumn("cluster", F.when(F.col("item") == "e", 1).otherwise(F.col("cluster")))
    assert tuple(cluster.off_centre(places, wrong, "item", ["x"]).first()) == (5, 2, 1)


def test_best_items_per_cluster(spark):
    table = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1)], "item string, num_players long")
    groups = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 1)], "item string, cluster int")
    rows = cluster.top_items_per_cluster(table, groups, n=2).orderBy("cluster", "rank").collect()
    assert [(r.cluster, r["item"]) for r in rows] == [(0, "c"), (0, "a"), (1, "d")]


def test_item_components(blobs):
    names = ["num_players", "avg_hours", "total_hours"]
    x = blobs.toPandas()[names].to_numpy()
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    rows = cluster.item_pca_components(blobs).toPandas()
    loadings = rows.pivot(index="component", columns="feature", values="loading")[names].to_numpy()
    assert np.allclose(loadings @ loadings.T, np.eye(2), atol=1e-9)
    assert np.allclose(np.abs(loadings), np.abs(vectors[:, :2].T), atol=1e-6)
    explained = rows.drop_duplicates("component").sort_values("component").explained_ratio
    assert np.allclose(explained, values[:2] / values.sum())
    places = cluster.item_pca(blobs).toPandas().set_index("item").loc[blobs.toPandas()["item"]].to_numpy()
    assert np.allclose(np.abs(places), np.abs(centred @ vectors[:, :2]), atol=1e-6)


def test_matrix_and_moments(events, dense):
    table, _ = dense
    moments = by_key(neighbors.item_moments(neighbors.user_item_matrix(events)))
    assert set(moments) == set(table.columns[table.std(ddof=0) > 0])
    for item, row in moments.items():
        assert row.mean == pytest.approx(table[item].mean())
        assert row.variance == pytest.approx(table[item].var(ddof=0))


def _nearest(z, user, n):
    norms = np.linalg.norm(z.to_numpy(), axis=1)
    scores = pd.Series(z.to_numpy() @ z.loc[user].to_numpy() / (norms * norms[z.index.get_loc(user)]), index=z.index)
    return scores.drop(user).round(9).sort_values(ascending=False, kind="stable").head(n)


@pytest.mark.parametrize("given", [True, False])
def test_similar_users(events, dense, given):
    _, z = dense
    user = int(z.index[3] if given else z.index[0])
    found = neighbors.similar_users(events, user if given else None).collect()
    expected = _nearest(z, user, 4)
    assert [r.neighbor_id for r in found] == list(expected.index)
    assert [r.similarity for r in found] == pytest.approx(list(expected))


def test_recommendations(events, dense):
    table, z = dense
    user = z.index[0]
    near = table.loc[_nearest(z, user, 4).index]
    expected = {i for i in table.columns if (near[i] > 0).any() and not table.loc[user, i] > 0}
    assert {r[0] for r in neighbors.recommend_items(events).collect()} == expected


def test_user_clusters_cover_all_users(events, dense):
    rows = neighbors.user_clusters(events).collect()
    assert {r.user_id for r in rows} == set(dense[0].index) and {r.cluster for r in rows} <= {0, 1, 2}


def _svd_places(z):
    u, s, _ = np.linalg.svd(z.to_numpy(), full_matrices=False)
    return pd.DataFrame(u[:, :2] * s[:2], index=z.index)


def test_user_components(events, dense):
    expected = _svd_places(dense[1])
    places = neighbors.user_pca(events).toPandas().set_index("user_id").loc[expected.index]
    assert np.allclose(np.abs(places), np.abs(expected), atol=1e-6)


def test_places_do_not_depend_on_the_block(events):
    usual = neighbors.user_pca(events).toPandas().set_index("user_id").sort_index()
    wide = neighbors.user_pca(events, oversample=13).toPandas().set_index("user_id").sort_index()
    assert np.allclose(usual, wide, atol=1e-6)


def test_an_unknown_user_has_no_neighbours(events):
    assert neighbors.similar_users(events, -5).collect() == [] and neighbors.recommend_items(events, -5).collect() == []


def test_unsettled_clusters_are_an_error(events):
    cells, columns = neighbors.scaled_cells(events)
    with pytest.raises(RuntimeError):
        cluster.fitted_kmeans(neighbors._vectors(cells, columns.count()), 5, max_iter=1)


def test_wide_components_say_when_they_do_not_settle(events):
    cells, columns = neighbors.scaled_cells(events)
    with pytest.raises(RuntimeError):
        wide_pca.wide_components(cells, columns, 2, oversample=0, max_rounds=1)


def test_users_without_any_hours_stay(log):
    rows = log((1, "X", "play", 4), (2, "X", "purchase", 1), (3, "Y", "play", 2))
    assert {r.user_id for r in neighbors.user_clusters(rows, k=2).collect()} == {1, 2, 3}
    assert {r.neighbor_id for r in neighbors.similar_users(rows, 1).collect()} == {2, 3}


def test_one_user_log(log):
    rows = log((1, "X", "play", 4))
    assert neighbors.similar_users(rows).collect() == [] and neighbors.recommend_items(rows).collect() == []


def test_features_come_from_plays(log):
    row = usage.item_feature_table(log((1, "X", "play", 4), (1, "X", "play", 2), (2, "X", "purchase", 1))).first()
    assert (row.num_players, row.avg_hours, row.total_hours) == (1, 3.0, 6.0)


def test_codes_lead_back_to_names(log):
    codes = neighbors.encode_items(log((1, "b", "play", 1), (1, "a", "play", 1)))
    names = neighbors.decode_items(codes.select("item_code"), codes)
    assert {r.item_code: r["item"] for r in names.collect()} == {0: "a", 1: "b"}
