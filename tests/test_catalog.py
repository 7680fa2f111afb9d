import json
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key, column
from usagelens.operators import catalog as cat
from usagelens.plans.reports import catalog_report, write_catalog_report


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [("Foo™", "RPG", "85", "7,5", "Nov 21, 2016"), ("Bar", "RPG", "tbd", "tbd", "2015-01"),
         ("  BAZ ", "Puzzle", "120", "9", "soon")],
        "`Game Title` string, `Genres` string, `Critic_Score` string, `User Score` string, `Released` string")


@pytest.fixture
def rows(log):
    return log((1, "foo", "play", 3), (2, "foo", "play", 5), (1, "bar", "play", 1), (1, "Baz", "play", 0),
               (1, "other", "play", 2), (1, "foo", "purchase", 1), (3, "foo", "purchase", 1))


def test_aliases_are_resolved(raw):
    shaped = by_key(cat.shape_catalog(raw), "title_clean")
    assert set(shaped) == {"foo", "bar", "baz"}
    assert (shaped["foo"].metascore, shaped["foo"].userscore, shaped["foo"].release_year) == (85.0, 7.5, 2016)
    assert shaped["bar"].metascore is None and shaped["baz"].release_year is None
    assert shaped["foo"].developer is None


def test_numeric_release_year_column(spark):
    df = spark.createDataFrame([("a", "2010"), ("b", "n/a")], "title string, release_year string")
    assert column(cat.shape_catalog(df).orderBy("title"), "release_year") == [2010, None]


def test_title_column_is_guessed_from_distinct_values(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", None, 3)], "kind string, label string, n int")
    assert cat.detect_title_column(df) == "label"
    assert cat.detect_title_column(df.withColumnRenamed("kind", "name")) == "name"
    with pytest.raises(ValueError):
        cat.detect_title_column(df.select("n"))


def test_scores(rows, raw):
    scored = by_key(cat.with_scores(cat.join_catalog_exact(rows, cat.shape_catalog(raw))))
    assert set(scored) == {"foo", "bar", "Baz"}
    assert scored["foo"].engagement_score == pytest.approx(0.85 * math.log1p(4))
    assert scored["foo"].quality_score == pytest.approx(0.6 * 0.85 + 0.4 * 0.75)
    assert scored["bar"].quality_score == 0
    assert scored["Baz"].quality_score == pytest.approx(0.6 + 0.36)


def test_repeated_titles_repeat_rows(rows, raw):
    catalog = cat.shape_catalog(raw)
    doubled = catalog.unionByName(catalog.withColumn("genre", F.lit("A")))
    assert cat.join_catalog_exact(rows, doubled).count() == 6
    assert cat.join_catalog_exact(rows, cat.dedupe_catalog(doubled)).count() == 3
    assert set(column(cat.dedupe_catalog(doubled), "genre")) == {"A"}


def test_left_and_anti_join(rows, raw):
    catalog = cat.shape_catalog(raw)
    left = by_key(cat.join_catalog_left(rows, catalog))
    assert left["other"].genre is None and left["Baz"].genre == "Puzzle"
    assert left["foo"].genre is None  # the plain key keeps the trade mark of the catalogue title
    assert (left["foo"].players, left["foo"].purchasers) == (2, 2)
    assert column(cat.unmatched_items(rows, catalog)) == ["other"]


def test_raw_join_groups_equal_the_row_level_join(rows, spark):
    catalog = cat.shape_catalog(spark.createDataFrame([("foo", "A"), ("foo", "A"), ("foo", "B"), ("x", "C")],
                                                      "title string, genre string"))
    joined = cat.join_catalog_raw(rows, catalog).groupBy("item", "behavior", "genre", "developer").agg(
        F.count("*").alias("entries"), F.sum("hours").alias("hours"))
    grouped = cat.join_catalog_raw_groups(rows, catalog).select(*joined.columns)
    assert sorted(map(str, grouped.collect())) == sorted(map(str, joined.collect()))
    assert cat.join_catalog_raw(rows, catalog, "left").where("genre IS NULL").count() == 3


def test_rollups(rows, raw):
    scored = cat.with_scores(cat.join_catalog_exact(rows, cat.shape_catalog(raw)))
    genres = cat.genre_scores(scored).collect()
    assert [g.genre for g in genres] == ["RPG", "Puzzle"]
    assert genres[0].metascore_mean == 85.0 and genres[0].playtime_mean == pytest.approx(2.5)
    assert column(cat.scores_by_year(scored), "release_year") == [2015, 2016]


def test_report_and_its_files(spark, rows, raw, tmp_path):
    report = catalog_report(rows, raw)
    assert report["report"].columns == list(cat.REPORT_COLUMNS)
    summary = report["insights"].first()
    best = json.loads(summary.top_quality)
    assert summary.joined_items == 3 and [b["item"] for b in best] == ["Baz", "foo", "bar"]
    assert json.loads(summary.notes) == []
    write_catalog_report(report, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/top_quality", header=True).count() == 3
    assert spark.read.json(f"{tmp_path}/insights").first().joined_items == 3


def test_other_catalogue_columns_stay(spark, log):
    raw = spark.createDataFrame([("foo", "80", 3.5, "x")], "title string, metascore string, price double, item string")
    shaped = cat.shape_catalog(raw)
    assert shaped.columns[-2:] == ["price", "item_catalog"]
    joined = cat.join_catalog_exact(log((1, "foo", "play", 2)), shaped).first()
    assert (joined.price, joined.item_catalog, joined["item"]) == (3.5, "x", "foo")


def test_profile_of_the_row_level_join_equals_its_rows(spark, log):
    from usagelens.operators.profile import profile_columns
    rows = log((1, "foo", "play", 2), (2, "foo", "play", None), (3, "bar", "purchase", 1), (4, None, "play", 1))
    titles = cat.shape_catalog(spark.createDataFrame([("foo", "A"), ("foo", None), ("x", "B")], "title string, genre string"))
    for how in ("inner", "left"):
        formed = profile_columns(cat.join_catalog_raw(rows, titles, how))
        assert sorted(cat.join_catalog_raw_profile(rows, titles, how).collect()) == sorted(formed.collect())


def test_raw_join_of_a_small_log_is_spread_over_tasks(spark, log):
    rows = log(*[(u, "foo", "play", u) for u in range(200)]).coalesce(1)
    titles = cat.shape_catalog(spark.createDataFrame([("foo", "A")] * 30, "title string, genre string"))
    for how in ("inner", "left"):
        tasks = cat.join_catalog_raw(rows, titles, how).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and sum(row["count"] for row in tasks) == 6000


def test_raw_join_rows_sum_every_column_of_every_row(spark, log):
    import hashlib
    from usagelens.plans.queries import raw_join_rows
    rows = [(1, "foo", "play", 2), (1, "foo", "play", 2), (None, "foo", None, None), (3, None, "purchase", 1), (None, None, None, None),
            (4, "", "play", 1.25)]
    titles = [("foo", "A", "x"), ("foo", None, "x"), ("foo", "A", "x"), ("", "B", None), (None, "C", "y")]
    catalog = spark.createDataFrame(titles, "title string, genre string, developer string")
    found = {"inner": [], "left": []}
    for row in rows:
        met = [t[1:] for t in titles if row[1] is not None and t[0] == row[1]]
        found["inner"] += [(row, t) for t in met]
        found["left"] += [(row, t) for t in met or [(None, None)]]
    for how, pairs in found.items():
        texts = ["|".join([str(x) for x in (u, i, b, None if h is None else round(h * 100)) if x is not None] + [g or "-", d or "-"])
                 for (u, i, b, h), (g, d) in pairs]
        expected = sum(int(hashlib.md5(text.encode()).hexdigest()[:8], 16) for text in texts)
        assert tuple(raw_join_rows(log(*rows), catalog, how).first()) == (len(pairs), sum(g is not None for _, (g, _) in pairs), expected)
