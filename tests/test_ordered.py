"""Sliced order statistics against NumPy and pandas on whole groups."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usagelens.functions import ordered
from usagelens.functions.joins import spread_join


def _skewed(n=3000, seed=7):
    """One group with a third of all rows, many repeated values."""
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 1 / 3, "hot", rng.integers(0, 20, n).astype(str))
    return pd.DataFrame({"g": group, "v": np.round(rng.exponential(20, n), 1)})


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_skewed_groups_match_numpy(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        data = _skewed()
        runs = ordered.value_runs(spark.createDataFrame(data), ["g"], "v")
        found = {r.g: r for r in runs.groupBy("g").agg(
            *[ordered.percentile_of_runs("v", p / 100).alias(f"p{p}") for p in (0, 25, 50, 75, 90, 95, 100)],
            ordered.mean_of_runs().alias("mean"), ordered.stddev_of_runs("v").alias("std"),
            ordered.gini_of_runs("v").alias("gini")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert set(found) == set(data.g)
    for g, values in data.groupby("g")["v"]:
        x = np.sort(values.to_numpy())
        for p in (0, 25, 50, 75, 90, 95, 100):
            assert found[g][f"p{p}"] == pytest.approx(np.percentile(x, p))
        assert found[g].mean == pytest.approx(x.mean())
        assert found[g].std == pytest.approx(x.std(ddof=1))
        weighted = (2 * np.arange(1, len(x) + 1) - len(x) - 1) @ x / (len(x) * x.sum())
        assert found[g].gini == pytest.approx(weighted)
        assert 0 <= found[g].gini < 1


def test_a_hot_group_is_cut_into_slices(spark, many_slices):
    data = spark.createDataFrame(_skewed()).where("g = 'hot'")
    counts = ordered.value_counts(data, ["g"], "v")
    slices = counts.repartitionByRange("g", "v").withColumn("s", F.spark_partition_id())
    assert slices.select("s").distinct().count() > 1


def test_running_totals_are_exact_across_slices(spark, many_slices):
    data = _skewed(500).reset_index(names="id")
    out = ordered.running_totals(spark.createDataFrame(data), ["g"], ["v", "id"], ["v"]).toPandas()
    expected = data.sort_values(["g", "v", "id"])
    expected["before"] = expected.groupby("g")["v"].cumsum() - expected["v"]
    merged = out.merge(expected[["id", "before"]], on="id")
    assert len(merged) == len(data)
    assert np.allclose(merged["v_before"], merged["before"])
    assert np.allclose(merged["v_all"], merged.groupby("g")["v"].transform("sum"))


def test_rank_shares_match_pandas(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = spark.createDataFrame([("m", v) for v in values], "metric string, value double")
    shares = {r.value: r.share for r in ordered.average_rank_shares(df, ["metric"], "value", "share").collect()}
    expected = pd.Series(values).rank(pct=True)
    assert [shares[v] for v in values] == pytest.approx(list(expected))
    assert [shares[v] for v in values] == pytest.approx([0.8, 0.2, 0.8, 0.4, 0.8])


def test_codes_follow_sorted_order(spark, many_slices):
    titles = ["b", "a", "Z", "ä", "b", "10", None]
    codes = ordered.dense_codes(spark.createDataFrame([(t,) for t in titles], "t string"), "t", "c")
    assert {r.t: r.c for r in codes.collect()} == {t: i for i, t in enumerate(sorted({t for t in titles if t}))}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.integers(1, 9))
def test_gini_ignores_scale(spark, values, factor):
    def gini(scale):
        df = spark.createDataFrame([(float(v * scale),) for v in values], "v double")
        return ordered.value_runs(df, [], "v").agg(ordered.gini_of_runs("v")).first()[0]
    assert gini(1) == pytest.approx(gini(factor), abs=1e-9)
    assert -1e-9 <= gini(1) < 1


def test_spread_join_equals_join(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 7).alias("k"))
    table = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, w long")
    for how in ("inner", "left"):
        found = spread_join(rows, table, ["k"], ["id"], how).select("id", "w").collect()
        plain = rows.join(table, "k", how).select("id", "w").collect()
        assert sorted(map(str, found)) == sorted(map(str, plain))


def test_spread_join_broadcasts_no_copies_of_a_table_below_the_threshold(spark, tmp_path):
    spark.range(2000).select("id", (F.col("id") * 7).alias("w")).coalesce(1).write.parquet(str(tmp_path / "table"))
    spark.range(5000).select((F.col("id") % 2000).alias("id"), F.col("id").alias("n")).write.parquet(str(tmp_path / "rows"))
    rows, table = (spark.read.parquet(str(tmp_path / name)) for name in ("rows", "table"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 30_000)  # more than the table's file, less than its 50 copies
        found = spread_join(rows, table, ["id"], ["n"], salts=50)
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
        assert found.where("w = 7 * id").count() == 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
