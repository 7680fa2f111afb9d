"""Every registered query against its SQL, and the plans behind them."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from usagelens.plans import oracle, queries
from tests.conftest import SAMPLE

QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()
ROWS_ONLY = {"kmeans_elbow", "kmeans_silhouette", "kmeans_silhouette_euclidean", "item_clusters", "item_clusters_zscore", "top_items_per_cluster",
             "user_clusters"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SAMPLE):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SAMPLE}/{file}'")
    return connection


def _sorted_rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) - set(ORACLE) == ROWS_ONLY


def _check_plan(df, python_allowed=False):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Ordered windows over values run inside a slice of a group, never over the group.
    assert not re.search(r"windowspecdefinition\((item#\d+, |metric#\d+, )?(hours|log_hours|value|total_hours)#", plan)
    assert python_allowed or not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, SAMPLE)
    _check_plan(result, python_allowed=name in ("join_catalog_fuzzy", "user_pca", "silhouette_score", "silhouette_by_cluster"))
    expected = duck.sql(ORACLE[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert _sorted_rows([tuple(r) for r in result.collect()], result.columns) == _sorted_rows(
        expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_models_give_rows(spark, name):
    result = QUERIES[name](spark, SAMPLE)
    _check_plan(result, python_allowed=True)
    assert result.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 15


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["active_plays"](spark, SAMPLE)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "event_type" in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double,props:string>" in plan
