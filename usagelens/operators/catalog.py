"""The item catalogue: bringing it into shape, joining usage to it, scores and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.frames import existing, top, where_keys
from usagelens.functions.joins import spread_join
from usagelens.functions.numeric import clip, ratio
from usagelens.functions.text import clean_title, rating, title_key, year_in
from usagelens.operators.fuzzy import title_matches
from usagelens.operators.profile import text_column_cardinality
from usagelens.operators.usage import avg_hours_by_item, item_usage, known_behavior
from usagelens.schema import GENRE_NAMES, METASCORE_NAMES, RELEASE_NAMES, TITLE_NAMES, USERSCORE_NAMES
from usagelens.sources.shaping import normalize_column_names
from usagelens.session import materialize

_OWN_NAMES = ("title", "title_clean", "genre", "developer", "metascore", "userscore", "release_year",
              "item", "item_clean", "avg_hours", "engagement_score", "quality_score")
REPORT_COLUMNS = ("title", "item", "avg_hours", "metascore", "userscore", "release_year", "genre",
                  "engagement_score", "quality_score")


def detect_title_column(df: DataFrame, candidates: Sequence[str] = TITLE_NAMES) -> str:
    """A known title name if there is one, else the text column with most distinct values."""
    named = existing(df, candidates)
    if named:
        return named[0]
    best = richest_text_column(df).first() if any(t == "string" for _, t in df.dtypes) else None
    if best is None:
        raise ValueError("no text column that could hold titles")
    return best["column_name"]


def richest_text_column(df: DataFrame) -> DataFrame:
    """One row: the text column with most distinct values, the leftmost on a tie."""
    return top(text_column_cardinality(df), 1, F.desc("distinct_values"), "position").drop("position")


def _first_named(df: DataFrame, names: Sequence[str]) -> str | None:
    found = existing(df, names)
    return found[0] if found else None


def shape_catalog(raw: DataFrame) -> DataFrame:
    """Raw catalogue to title, title_clean, genre, developer, metascore, userscore, release_year and all other columns.

    Another column that bears the name of one of these, or of a column the joins add, gets the ending `_catalog`.
    """
    df = normalize_column_names(raw)
    title_name = detect_title_column(df)
    title = F.col(title_name).cast("string")
    release = _first_named(df, RELEASE_NAMES)
    taken = {title_name, release, "developer", *[_first_named(df, names) for names in (GENRE_NAMES, METASCORE_NAMES, USERSCORE_NAMES)]}
    others = [F.col(c).alias(f"{c}_catalog" if c in _OWN_NAMES else c) for c in df.columns if c not in taken]

    def optional(name: str | None, expression, kind: str) -> Column:
        return expression(F.col(name)) if name else F.lit(None).cast(kind)

    release_rule = (lambda c: rating(c).cast("int")) if release == "release_year" else year_in
    return df.select(
        title.alias("title"),
        clean_title(title).alias("title_clean"),
        optional(_first_named(df, GENRE_NAMES), lambda c: c.cast("string"), "string").alias("genre"),
        optional(_first_named(df, ("developer",)), lambda c: c.cast("string"), "string").alias("developer"),
        optional(_first_named(df, METASCORE_NAMES), rating, "double").alias("metascore"),
        optional(_first_named(df, USERSCORE_NAMES), rating, "double").alias("userscore"),
        optional(release, release_rule, "int").alias("release_year"),
        *others,
    )


def dedupe_catalog(catalog: DataFrame, order: str | None = None) -> DataFrame:
    """One catalogue row per cleaned title; for joins that must not fan out.

    `order` names a column, such as a record number, whose least value decides; else the least row by value does.
    """
    return _first_per_key(catalog, "title_clean", order)


def _first_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Least row per key. `min` combines before the shuffle, so copies of one key stay cheap."""
    rest = [c for c in df.columns if c not in (key, order)]
    rest = [order, *rest] if order else rest
    least = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def item_mean_hours(interactions: DataFrame) -> DataFrame:
    """Mean play hours per item with the item's join key."""
    means = avg_hours_by_item(known_behavior(interactions))
    return means.withColumn("item_clean", clean_title(F.col("item")))


def _join_titles(items: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    return items.join(catalog, items["item_clean"] == catalog["title_clean"], how)


def join_catalog_exact(interactions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items joined to the catalogue on cleaned titles; repeated titles give repeated rows."""
    return _join_titles(item_mean_hours(interactions), catalog)


def unmatched_items(interactions: DataFrame, catalog: DataFrame) -> DataFrame:
    return _join_titles(item_mean_hours(interactions), catalog.select("title_clean").distinct(), "left_anti")


def join_catalog_fuzzy(interactions: DataFrame, catalog: DataFrame, cutoff: float = 0.93, near: bool = True,
                       one_row_per_item: bool = True, order: str | None = None) -> DataFrame:
    """Exact join, plus (`near`) the nearest title for items without one.

    `one_row_per_item` keeps one catalogue row of repeated titles, the first by `order` or else the least by value. Neither
    depends on what the tables hold.
    """
    items = item_mean_hours(interactions)
    if near:
        items, catalog = materialize(items), materialize(catalog)  # one row per item or title, read several times
    exact = _join_titles(items, catalog)
    both = exact
    if near:
        rest = _join_titles(items, catalog.select("title_clean").distinct(), "left_anti")
        matches = title_matches(rest, catalog, "item_clean", "title_clean", cutoff).select("item_clean", "title_clean")
        both = exact.unionByName(rest.join(matches, "item_clean").join(catalog, "title_clean"))
    return _first_per_key(both, "item_clean", order).select(*exact.columns) if one_row_per_item else both


def join_catalog_left(interactions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Usage of every item with its genre, NULL for items the catalogue lacks."""
    usage = item_usage(interactions).withColumn("key", title_key(F.col("item")))
    genres = catalog.select(title_key(F.col("title")).alias("key"), "genre")
    return usage.join(genres, "key", "left")


def join_catalog_raw(interactions: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """Log rows joined to genre and developer on the title as written; a title's rows are joined by many tasks."""
    named = catalog.select(F.col("title").alias("item"), "genre", "developer")
    return spread_join(interactions, named, ["item"], [c for c in interactions.columns if c != "item"], how, deal=True)


def join_catalog_raw_profile(interactions: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """Column, type and non-null count over the rows of `join_catalog_raw`, which are counted, not formed."""
    log_columns, named = [c for c in interactions.columns if c != "item"], ("genre", "developer")
    log = interactions.groupBy("item").agg(F.count("*").alias("_rows"), F.count("item").alias("n_item"),
                                           *[F.count(c).alias(f"n_{c}") for c in log_columns])
    titles = where_keys(catalog, "title").groupBy(F.col("title").alias("item")).agg(
        F.count("*").alias("_titles"), *[F.count(c).alias(f"_{c}") for c in named])
    each = F.coalesce("_titles", F.lit(1))  # a row without a title stays one row
    totals = log.join(titles, "item", how).agg(
        *[F.coalesce(F.sum(F.col(f"n_{c}") * each), F.lit(0)).alias(c) for c in ("item", *log_columns)],
        *[F.coalesce(F.sum(F.col("_rows") * F.col(f"_{c}")), F.lit(0)).alias(c) for c in named])
    joined = [("item", dict(interactions.dtypes)["item"]), *[(c, dict(interactions.dtypes)[c]) for c in log_columns],
              *[(c, dict(catalog.dtypes)[c]) for c in named]]
    types = F.create_map(*[F.lit(x) for pair in joined for x in pair])
    return totals.unpivot([], [name for name, _ in joined], "column_name", "non_null").select(
        "column_name", types[F.col("column_name")].alias("data_type"), "non_null")


def join_catalog_raw_groups(interactions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows and hours of the row-level join per item, behaviour, genre and developer.

    Both sides are counted before they meet, so the pairs of log rows and equal titles are multiplied,
    not formed.
    """
    log = where_keys(interactions, "item").groupBy("item", "behavior").agg(
        F.count("*").alias("_rows"), F.sum("hours").alias("_hours"))
    titles = where_keys(catalog, "title").groupBy(F.col("title").alias("item"), "genre", "developer").agg(
        F.count("*").alias("_titles"))
    return log.join(titles, "item").select(
        "item", "behavior", "genre", "developer",
        (F.col("_rows") * F.col("_titles")).alias("entries"), (F.col("_hours") * F.col("_titles")).alias("hours"))


def engagement_score(metascore: Column, avg_hours: Column) -> Column:
    """Review score as a share, times damped playing time; a missing score counts 0."""
    return clip(F.coalesce(metascore, F.lit(0.0)), 0, 100) / 100 * F.log1p(clip(avg_hours, 0))


def quality_score(metascore: Column, userscore: Column) -> Column:
    """Weighted review scores of critics and users; missing ones count 0."""
    critics = clip(F.coalesce(metascore, F.lit(0.0)), 0, 100) / 100
    users = clip(F.coalesce(userscore, F.lit(0.0)), 0, 10) / 10
    return 0.6 * critics + 0.4 * users


def with_scores(joined: DataFrame) -> DataFrame:
    return (joined
            .withColumn("engagement_score", engagement_score(F.col("metascore"), F.col("avg_hours")))
            .withColumn("quality_score", quality_score(F.col("metascore"), F.col("userscore"))))


def score_report(joined: DataFrame) -> DataFrame:
    """Joined items with both scores, in report columns."""
    scored = with_scores(joined)
    return scored.select(*existing(scored, REPORT_COLUMNS))


def top_by_score(report: DataFrame, score: str, n: int = 20) -> DataFrame:
    """Best report rows; all other columns settle ties."""
    rest = [c for c in report.columns if c != score]
    return top(report.withColumn(score, F.round(score, 9)), n, F.desc_nulls_last(score), *rest)


def genre_scores(scored: DataFrame, n: int | None = 15) -> DataFrame:
    """Mean scores per genre, best engagement first; `n=None` keeps every genre."""
    means = where_keys(scored, "genre").groupBy("genre").agg(
        F.avg("metascore").alias("metascore_mean"),
        F.avg("userscore").alias("userscore_mean"),
        F.avg("avg_hours").alias("playtime_mean"),
        F.avg("engagement_score").alias("engagement_mean"))
    ordered = means.orderBy(F.desc_nulls_last("engagement_mean"), "genre")
    return ordered if n is None else ordered.limit(n)


def scores_by_year(scored: DataFrame) -> DataFrame:
    return where_keys(scored, "release_year").groupBy("release_year").agg(
        F.avg("metascore").alias("metascore_mean"),
        F.avg("userscore").alias("userscore_mean"),
        F.avg("avg_hours").alias("playtime_mean")).orderBy("release_year")


def genre_usage(usage_with_genre: DataFrame) -> DataFrame:
    """Players, hours, items and purchasers per genre, over rows of `join_catalog_left`."""
    totals = where_keys(usage_with_genre, "genre").groupBy("genre").agg(
        F.sum("players").alias("total_players"),
        F.sum("total_hours").alias("total_hours"),
        F.count_distinct("item").alias("items"),
        F.sum("purchasers").alias("total_purchasers"))
    return totals.select(
        "*",
        ratio(F.col("total_hours"), F.col("total_players")).alias("avg_hours_per_player"),
        ratio(F.col("total_purchasers"), F.col("total_players")).alias("purchase_ratio"))


def top_genres(usage_by_genre: DataFrame, measure: str, n: int = 15) -> DataFrame:
    return top(usage_by_genre, n, F.desc_nulls_last(measure), "genre")


def usage_bubble_points(usage: DataFrame) -> DataFrame:
    """Players against hours per player."""
    return usage.select(F.col("item").alias("label"), F.col("players").alias("x"),
                        F.col("avg_hours_per_player").alias("y"))


def insights_summary(report: DataFrame, n: int = 5, notes: Sequence[str] = ()) -> DataFrame:
    """One row: number of joined rows and the best n by each score as JSON.

    Only the n best rows of each list are ever brought together.
    """
    def best(score: str) -> Column:
        rest = [c for c in report.columns if c != score]
        # Descending order inside the array: the negated score leads, the other columns settle ties.
        rows = top_by_score(report, score, n).select(
            F.struct((-F.col(score)).alias("_order"), *rest, score).alias("row"))
        lists = rows.agg(F.sort_array(F.collect_list("row")).alias("rows"))
        plain = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in report.columns]))
        return lists.select(F.to_json(plain)).scalar()

    return report.agg(F.count("*").alias("joined_items")).select(
        "joined_items",
        best("engagement_score").alias("top_engagement"),
        best("quality_score").alias("top_quality"),
        F.to_json(F.array(*[F.lit(text) for text in notes]).cast("array<string>")).alias("notes"))
