"""Small inputs with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key, column
from usagelens.functions.numeric import clip, to_double
from usagelens.functions.text import clean_title, rating, year_in
from usagelens.operators import distribution, neighbors, ownership, profile, retention, segments, usage


def plays(item, *hours, first_user=1):
    return [(first_user + i, item, "play", h) for i, h in enumerate(hours)]


def test_numbers_in_text(texts):
    df = texts("2.5", "tbd", "", "1d", " 3.0 ", None)
    assert column(df.select(to_double(F.col("text")))) == [2.5, None, None, None, 3.0, None]


def test_clip_keeps_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (-1.0D), (50.0D), (150.0D), (NULL) AS t(v)")
    assert column(df.select(clip(F.col("v"), 0, 100))) == [0.0, 50.0, 100.0, None]


def test_splits_at_the_limit(log):
    rows = log(*plays("X", 2.9, 3.0, 3.1), (9, "X", "purchase", 1.0))
    everything = segments.tester_stayer_all_rows(rows).first()
    assert (everything.tester, everything.stayer) == (2, 2)
    played = segments.tester_stayer_3h(rows).first()
    assert (played.testers, played.stayers) == (2, 1)
    strict = segments.bucket_share_strict(rows, limit=3).first()
    assert (strict.under, strict.over) == (1, 1)
    closed = segments.bucket_share_min_entries(rows, limit=3, min_entries=1).first()
    assert (closed.under, closed.at_or_over) == (1, 2)


def test_missing_hours_count_as_stayer(log):
    row = segments.tester_stayer_all_rows(log((1, "X", "play", None), (2, "X", "play", 1))).first()
    assert (row.tester, row.stayer, row.stayer_percent) == (1, 1, 50.0)


def test_repeated_plays(log):
    rows = log((1, "X", "play", 2), (1, "X", "play", 5))
    assert usage.avg_hours_by_item(rows).first().avg_hours == 3.5
    assert usage.user_item_hours_sum(rows).first().hours == 7.0
    assert usage.user_item_hours_max(rows).first().hours == 5.0


def test_owners_and_players_differ(log):
    rows = log((1, "X", "purchase", 1), (2, "X", "play", 4), (3, "X", "purchase", 1), (3, "X", "play", 6))
    owned = ownership.owner_engagement(rows).first()
    assert (owned.owners, owned.players, owned.avg_hours_per_owner, owned.median_hours_per_owner) == (2, 1, 3.0, 3.0)
    assert owned.share_played == 0.5 and owned.ownership_rate == pytest.approx(2 / 3)
    kept = retention.retention_by_item(rows, min_buyers=1).first()
    assert (kept.buyers, kept.players, kept.retention_rate, kept.avg_playtime) == (2, 2, 100.0, 5.0)


def test_gini(log):
    def gini(*hours):
        return distribution.gini_by_item(log(*plays("X", *hours))).first().gini
    assert gini(1, 1, 1, 1) == pytest.approx(0)
    assert gini(0, 0, 0, 4) == pytest.approx(0.75)
    assert gini(0, 0) == 0
    users = distribution.gini_users(log(*plays("X", 1, 1, 1, 1))).first()
    assert users.gini == pytest.approx(0.0625) and users.gini_exact == pytest.approx(0)


def test_no_users_no_gini(log):
    assert distribution.gini_users(log((1, "X", "purchase", 1))).first().gini is None


def test_percentiles_and_deviation(log):
    rows = log(*plays("X", 0.1, 0.5, 2, 7.5, 11, 300))
    tail = distribution.tail_percentiles_by_item(rows, min_players=1).first()
    assert [tail.p25, tail.p50, tail.p75, tail.p90, tail.p95] == pytest.approx([0.875, 4.75, 10.125, 155.5, 227.75])
    stats = distribution.mean_vs_median_by_item(rows, min_players=1).first()
    assert stats.std_hours == pytest.approx(120.8282320762274)
    assert stats.diff_mean_median == pytest.approx(53.51666666666667 - 4.75)


def test_single_player_and_zero_median(log):
    stats = by_key(distribution.mean_vs_median_by_item(log(*plays("X", 5), *plays("Y", 0, 0, 3)), min_players=1))
    assert stats["X"].std_hours is None
    assert stats["Y"].ratio_mean_median is None and stats["Y"].mean_hours == pytest.approx(1)


def test_titles(texts):
    df = texts("  Foo™ ", "Foo ™", "A  b", None)
    assert column(df.select(clean_title(F.col("text")))) == ["foo", "foo", "a b", None]
    assert column(df.select(clean_title(F.col("text"), strict=True))) == ["foo", "foo ", "a b", "nan"]


def test_ratings_and_years(texts):
    assert column(texts("tbd", "85%", "7,5", "", "88").select(rating(F.col("text")))) == [None, 85.0, 7.5, None, 88.0]
    assert column(texts("Nov 21, 2016", "2016-05", "soon").select(year_in(F.col("text")))) == [2016, 2016, None]


def test_correlation_with_a_constant(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "x int, c int")
    cells = {(r.column_a, r.column_b): r.correlation for r in profile.correlation_matrix(df).collect()}
    assert cells[("x", "x")] == pytest.approx(1)
    assert cells[("x", "c")] is None and cells[("c", "x")] is None and cells[("c", "c")] is None


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0), (4.0, float("nan"))], "x double, y double")
    cells = {(r.column_a, r.column_b): r.correlation for r in profile.correlation_matrix(df).collect()}
    assert cells[("x", "y")] == pytest.approx(-1)


def test_empty_side_of_a_split_is_zero(log):
    row = segments.tester_stayer_3h(log(*plays("X", 1, 1))).first()
    assert (row.stayers, row.stayers_share, row.testers_share) == (0, 0.0, 1.0)


def test_quadrants(spark):
    items = spark.createDataFrame([("a", 100, 50, 50.0, 10.0), ("b", 100, 100, 100.0, 20.0)],
                                  "item string, buyers long, players long, retention_rate double, avg_playtime double")
    medians = retention.retention_medians(items).first()
    assert (medians.median_retention, medians.median_playtime) == (75.0, 15.0)
    counts = retention.retention_quadrant_counts(items).collect()
    assert [(r.quadrant, r["items"]) for r in counts] == [
        ("Oben Rechts", 1), ("Oben Links", 0), ("Unten Rechts", 0), ("Unten Links", 1)]


def test_quadrants_of_nothing(spark):
    items = spark.createDataFrame([], "item string, buyers long, players long, retention_rate double, avg_playtime double")
    assert [r["items"] for r in retention.retention_quadrant_counts(items).collect()] == [0, 0, 0, 0]


def test_retention_labels(spark):
    df = spark.sql("SELECT * FROM VALUES (39.9D), (40.0D), (80.0D), (80.1D), (90.0D), (90.1D) AS t(r)")
    assert column(df.select(retention.retention_label(F.col("r")))) == [
        "Niedrig (<40%)", "Mittel (40-80%)", "Mittel (40-80%)", "Hoch (>80%)", "Hoch (>80%)", "Hoch (>80%)"]
    assert column(df.select(retention.retention_label(F.col("r"), high=90)))[4:] == ["Mittel (40-90%)", "Hoch (>90%)"]


def test_histogram_edges(spark):
    def counts(values, bins):
        runs = spark.createDataFrame([(float(v), 1) for v in values], "v double, n long")
        low, high = float(min(values)), float(max(values))
        bins_df = distribution.histogram(runs, [], "v", F.lit(low), F.lit(high), bins)
        return column(bins_df.orderBy("bin"), "entries")
    assert counts([0, 5, 10], 2) == [1, 2]
    assert counts([4, 4], 4) == [0, 0, 2, 0]
    assert counts([0, 0.3, 0.6, 0.9, 3.0], 10) == [1, 1, 1, 1, 0, 0, 0, 0, 0, 1]


def test_matrix_halves_a_bought_and_played_pair(log):
    cell = neighbors.user_item_matrix(log((1, "X", "purchase", 1), (1, "X", "play", 10))).first()
    assert cell.hours == 5.0


def test_retention_over_hundred(log):
    rows = log((1, "X", "purchase", 1), (2, "X", "purchase", 1), *plays("X", 1, 1, 1, first_user=3))
    assert retention.retention_by_item(rows, min_buyers=1).first().retention_rate == 150.0


def test_ownership_rates(log):
    rows = log(*[(u, "X", "purchase", 1) for u in (1, 2, 3)], (4, "Y", "play", 1))
    one = ownership.ownership_ratio_item(rows, "X").first()
    assert (one.owners, one.non_owners, one.ratio_percent) == (3, 1, 300)
    assert ownership.ownership_rate_vs_non_owners(rows).first().ownership_rate == 300.0
    assert ownership.ownership_rate_all_users(rows).first().ownership_rate == 75.0
    assert column(ownership.non_owners(rows, "X")) == [4]


def test_item_everyone_owns(log):
    rows = log((1, "X", "purchase", 1), (2, "X", "purchase", 1))
    assert ownership.ownership_rate_vs_non_owners(rows).first().ownership_rate is None
    assert ownership.ownership_ratio_item(rows, "X").first().ratio_percent is None


def test_user_stats_keep_both_sides(log):
    rows = by_key(usage.user_collector_stats(log(
        (1, "X", "purchase", 1), (2, "X", "play", 3), (3, "X", "play", 0))), "user_id")
    assert set(rows) == {1, 2}
    assert (rows[1].owned_items, rows[1].total_hours) == (1, 0.0)
    assert (rows[2].owned_items, rows[2].total_hours) == (0, 3.0)


def test_missing_group_keys_drop_out(log):
    rows = log((1, None, "play", 1), (1, "X", "play", 2))
    for operator in (usage.total_hours_by_item, usage.players_by_item, usage.avg_hours_by_item,
                     usage.item_usage, usage.entries_by_item):
        assert column(operator(rows), "item") == ["X"]


def test_boxes(log):
    box = distribution.hours_boxstats_by_item(log(*plays("X", 1, 2, 3, 4, 100))).first()
    assert (box.q1, box.median, box.q3, box.whisker_low, box.whisker_high, box.outliers) == (2, 3, 4, 1, 4, 1)


def test_lorenz_points(log):
    points = distribution.lorenz_top_items(log(*plays("X", 3, 1))).orderBy("rank").collect()
    assert [(p.user_share, p.hours_share) for p in points] == [(0.0, 0.25), (1.0, 1.0)]
    zero = distribution.lorenz_top_items(log(*plays("X", 0))).first()
    assert (zero.user_share, zero.hours_share) == (0.0, 0.0)
    users = distribution.lorenz_users(log(*plays("X", 3, 1))).orderBy("rank").collect()
    assert [(p.user_id, p.user_share, p.hours_share) for p in users] == [(2, 0.5, 0.25), (1, 1.0, 1.0)]
