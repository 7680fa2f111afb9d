"""Nearest titles without comparing every title with every other.

The similarity is 2·M / (|a| + |b|), with M the characters in matching blocks. At similarity c or
more, a and b differ by at most (1 - c)·(|a| + |b|) inserted or deleted characters, and each of those
destroys at most q of a title's q-grams and moves the others by at most one place. Order all q-grams
by rarity: fewer than q·d + 1 of a title come before the rarest one that survives in both, with d the
most edits the title's length allows. So both titles keep that q-gram when each keeps those ranked up
to q·d + 1, ties included, and its places differ by at most the pair's edits (prefix and position
filtering, as in the published similarity joins). Pairs without such a q-gram are never formed, and no
pair is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from usagelens.functions.joins import spread_join


_WIDE = 4


def gram_size(cutoff: float) -> int:
    """Largest q for which every title has more than q·d q-grams."""
    q = int(cutoff / (4 * (1 - cutoff)) + 1e-9) if cutoff < 1 else 4
    if q < 1:
        raise ValueError("near titles need a cutoff of at least 0.8")
    return q


def most_edits(length: Column, cutoff: float) -> Column:
    """Most single-character edits between a title of this length and any title similar to it."""
    return F.floor(length * (2 * (1 - cutoff) / cutoff) + 1e-9).cast("int")


def letters_in_common(a: Column, b: Column) -> Column:
    """Letters two titles share in any order, repeats counted: never less than their matching blocks."""
    def times(text: Column, letter: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0),
                       lambda seen, letter: seen + F.least(times(a, letter), times(b, letter)))


def _grams(titles: DataFrame, title: str, q: int) -> DataFrame:
    """Rows (title, place, gram)."""
    starts = F.sequence(F.lit(1), F.length(title) - q + 1)
    cut = F.transform(starts, lambda i: F.substring(F.col(title), i, F.lit(q)))
    return titles.where(F.length(title) >= q).select(title, F.posexplode(cut).alias("place", "gram"))


def _rare_grams(grams: DataFrame, frequency: DataFrame, title: str, q: int, cutoff: float) -> DataFrame:
    """The rarest grams of each title, as many as the filter asks for."""
    counted = spread_join(grams, frequency, ["gram"], [title, "place"])
    by_rarity = Window.partitionBy(title).orderBy("frequency", "gram")
    ranked = counted.withColumn("_rank", F.rank().over(by_rarity))
    edits = most_edits(F.length(title), cutoff)
    return ranked.where((edits >= 1) & (F.col("_rank") <= edits * q + 1)).select(
        title, "gram", F.col("place").alias(f"{title}_place"))


@F.pandas_udf(DoubleType())
def title_similarity(word: pd.Series, option: pd.Series) -> pd.Series:
    """Share of characters in matching blocks; the word is the second sequence of the matcher."""
    matcher, last, scores = SequenceMatcher(), None, []
    for w, o in zip(word, option):
        if w != last:
            matcher.set_seq2(w)
            last = w
        matcher.set_seq1(o)
        scores.append(matcher.ratio())
    return pd.Series(scores, dtype="float64")


def _on_grid(grams: DataFrame, title: str, cutoff: float, spread: bool) -> DataFrame:
    """Adds the cell of a gram's place and its title's length to the join key.

    Options are put into every cell that a partner within their edits can lie in; words into their own one. Cells are
    one wide for options with few edits, else `_WIDE`; words stand in both grids, as they may meet either kind.
    """
    place, length = F.col(f"{title}_place"), F.length(title)
    wide = F.lit(_WIDE)
    if not spread:
        held = grams.withColumn("_grid", F.explode(F.array(F.lit(1), wide)))
        return held.withColumn("_place", F.floor(place / F.col("_grid"))).withColumn("_length", F.floor(length / F.col("_grid")))
    held = grams.withColumn("_reach", most_edits(length, cutoff)).withColumn("_grid", F.when(F.col("_reach") <= 2, 1).otherwise(wide))

    def cells(at: Column) -> Column:
        return F.explode(F.sequence(F.floor((at - F.col("_reach")) / F.col("_grid")), F.floor((at + F.col("_reach")) / F.col("_grid"))))

    return held.withColumn("_place", cells(place)).withColumn("_length", cells(length)).drop("_reach")


def candidate_pairs(words: DataFrame, options: DataFrame, word: str, option: str, cutoff: float) -> DataFrame:
    """Distinct pairs that may reach the cutoff; no pair that reaches it with unequal titles is missing."""
    q = gram_size(cutoff)
    word_grams, option_grams = _grams(words, word, q), _grams(options, option, q)
    frequency = (word_grams.select("gram").unionAll(option_grams.select("gram"))
                 .groupBy("gram").agg(F.count("*").alias("frequency")))
    rare_words = _rare_grams(word_grams, frequency, word, q, cutoff)
    rare_options = _rare_grams(option_grams, frequency, option, q, cutoff)
    # The edits of the pair bound the difference in length as well as in place.
    edits = (F.length(word) + F.length(option)) * (1 - cutoff) + 1e-9
    near = ((F.abs(F.length(word) - F.length(option)) <= edits)
            & (F.abs(F.col(f"{word}_place") - F.col(f"{option}_place")) <= edits))
    keys = ["gram", "_grid", "_place", "_length"]
    pairs = (_on_grid(rare_words, word, cutoff, spread=False).join(_on_grid(rare_options, option, cutoff, spread=True), keys)
             .where(near).select(word, option).distinct())
    return pairs.where(letters_in_common(F.col(word), F.col(option)) * 2
                       >= (F.length(word) + F.length(option)) * cutoff - 1e-9)


def title_matches(words: DataFrame, options: DataFrame, word: str, option: str,
                  cutoff: float = 0.93) -> DataFrame:
    """The most similar option per word at or over the cutoff; the greater title wins a tie."""
    def distinct_titles(df: DataFrame, name: str) -> DataFrame:
        return df.select(name).where(F.col(name).isNotNull()).distinct()

    words, options = distinct_titles(words, word), distinct_titles(options, option)
    near = candidate_pairs(words, options, word, option, cutoff)
    equal = words.join(options, F.col(word) == F.col(option))
    scored = near.where(F.col(word) != F.col(option)).withColumn(
        "similarity", title_similarity(F.col(word), F.col(option)))
    found = scored.where(F.col("similarity") >= cutoff).unionByName(
        equal.withColumn("similarity", F.lit(1.0)))
    best = found.groupBy(word).agg(F.max(F.struct("similarity", option)).alias("_best"))
    return best.select(word, F.col(f"_best.{option}").alias(option), F.col("_best.similarity").alias("similarity"))
