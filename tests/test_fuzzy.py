"""Near titles against comparing every pair with the standard library's matcher."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from usagelens.operators import catalog, fuzzy


def _titles(n=120, seed=3):
    """Titles of many lengths that share a long common part, with near copies of each other."""
    rng = random.Random(seed)
    words = ["star", "war", "the", "of", "edition", "craft", "ring", "aaaa", "zone", "x", "7", "über", "quest"]
    base = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(n)}
    base = sorted(base | {"call of duty modern warfare " + str(rng.randint(0, 10 ** 9)) for _ in range(n // 3)})
    result = set(base)
    for title in base:
        chars = list(title)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(chars) + 1)
            if rng.random() < 0.5:
                chars.insert(at, rng.choice("abcxyz "))
            elif chars and at < len(chars):
                chars.pop(at)
        result.add("".join(chars))
    return sorted(t for t in result if t)


def _ratio(word, option):
    return SequenceMatcher(None, option, word).ratio()


@pytest.mark.parametrize("cutoff", [0.93, 0.85])
def test_no_near_pair_is_missing(spark, cutoff):
    titles = _titles()
    words, options = titles[::2], titles[1::2]
    pairs = fuzzy.candidate_pairs(spark.createDataFrame([(w,) for w in words], "w string"),
                                  spark.createDataFrame([(o,) for o in options], "o string"), "w", "o", cutoff)
    found = {(r.w, r.o) for r in pairs.collect()}
    wanted = {(w, o) for w in words for o in options if _ratio(w, o) >= cutoff}
    assert wanted and wanted <= found
    assert len(found) < len(words) * len(options) / 4


def test_best_match_is_the_closest(spark):
    titles = _titles(seed=11)
    words, options = titles[::2], titles[1::2]
    best = fuzzy.title_matches(spark.createDataFrame([(w,) for w in words], "w string"),
                               spark.createDataFrame([(o,) for o in options], "o string"), "w", "o", 0.93)
    expected = {w: m[0] for w in words if (m := get_close_matches(w, options, n=1, cutoff=0.93))}
    assert expected and {r.w: r.o for r in best.collect()} == expected


def test_known_ratios(spark):
    words = spark.createDataFrame([("small ring",), ("abc",)], "w string")
    options = spark.createDataFrame([("small rring",), ("abd",)], "o string")
    rows = fuzzy.title_matches(words, options, "w", "o").collect()
    assert [(r.w, r.o, round(r.similarity, 3)) for r in rows] == [("small ring", "small rring", 0.952)]


def test_cutoffs_too_low_to_filter_are_refused():
    with pytest.raises(ValueError):
        fuzzy.gram_size(0.7)


@pytest.fixture
def tables(spark, log):
    rows = log((1, "Small Ring", "play", 2), (2, "Small Ring", "play", 4), (1, "Old Gear", "play", 1),
               (1, "Nothing Like It", "play", 1))
    titles = spark.createDataFrame(
        [("small rring", "A"), ("small rring", "B"), ("old gear", "C"), ("old gear", "D")], "title string, genre string")
    return rows, catalog.shape_catalog(titles)


def test_near_titles_and_rows_per_item_are_the_callers_choice(tables):
    rows, titles = tables
    assert sorted(column(catalog.join_catalog_fuzzy(rows, titles, near=False, one_row_per_item=False), "genre")) == ["C", "D"]
    assert column(catalog.join_catalog_fuzzy(rows, titles, near=False), "genre") == ["C"]
    assert {r["item"]: r.genre for r in catalog.join_catalog_fuzzy(rows, titles).collect()} == {"Old Gear": "C", "Small Ring": "A"}
    every = catalog.join_catalog_fuzzy(rows, titles, one_row_per_item=False)
    assert sorted(column(every, "genre")) == ["A", "B", "C", "D"]
    # Nothing that was found elsewhere changes the rows of an item.
    rows = rows.where(F.col("item") != "Small Ring")
    assert column(catalog.join_catalog_fuzzy(rows, titles), "genre") == ["C"]


def test_an_order_column_decides_between_equal_titles(spark, log):
    raw = spark.createDataFrame([("old gear", "A", 2), ("old gear", "B", 1)], "title string, genre string, record int")
    titles = catalog.shape_catalog(raw)
    rows = log((1, "Old Gear", "play", 1))
    assert column(catalog.join_catalog_fuzzy(rows, titles, order="record"), "genre") == ["B"]
    assert column(catalog.dedupe_catalog(titles, "record"), "genre") == ["B"]


def test_long_titles_with_several_edits_are_not_lost(spark):
    rng = random.Random(5)
    letters = "abcdefghij "
    titles = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 60))).strip() for _ in range(150)]

    def edited(title):
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(title))
            title = title[:at] + rng.choice(["", rng.choice(letters), title[at] + rng.choice(letters)]) + title[at + 1:]
        return title

    words = sorted({edited(t) for t in titles})
    ratio = lambda w, o: SequenceMatcher(None, o, w).ratio()
    wanted = {(w, o) for w in words for o in titles if w != o and ratio(w, o) >= 0.93}
    pairs = fuzzy.candidate_pairs(spark.createDataFrame([(w,) for w in words], "w string"),
                                  spark.createDataFrame([(o,) for o in sorted(set(titles))], "o string"), "w", "o", 0.93)
    assert len(wanted) > 20 and wanted <= {(r.w, r.o) for r in pairs.collect()}
