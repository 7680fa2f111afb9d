"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions alone.

A seed is a fixed mask over consecutive tokens; tokens on its 0 places are ignored, so a hash of the others
still agrees when those were substituted. Hashes of all places of all test items meet the hashes of all places
of all documents. A hit fixes how item and document lie on each other; along that diagonal the stretch with the
best balance of equal and different tokens is taken (`best_stretch`), so that substitutions between hits count as
such. A document is contaminated by an item when the stretch is long and equal enough.

Tokens are runs of letters and digits of the lower-cased text, compared by their 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.joins import spread_join
from usagelens.llm.common import save

# Fixed masks, as distances between two pairs of adjacent tokens: 3 is the mask 11011, 4 is 110011. A
# substitution on an ignored place, or beside the mask, leaves the hash as it is.
GAPS = (3, 4)
MIN_TOKENS = 12
MIN_EQUAL = 0.8
PENALTY = 2
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Token hashes of a text; none for NULL."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda word: F.xxhash64(word))


def _zip_hash(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def _positions(df: DataFrame, runs: Sequence[int]) -> DataFrame:
    """One row per place of `df(held)` where a seed may start, with a hash `lead` of what every seed there begins with.

    That is the pair of tokens at the place, or the token alone where single tokens are looked for.
    """
    held, n = F.col("held"), F.size("held")
    paired = df.withColumn("_pairs", F.when(n >= 2, _zip_hash(F.slice(held, F.lit(1), n - 1), F.slice(held, F.lit(2), n - 1)))
                           .otherwise(F.array().cast("array<bigint>")))
    return paired.select("*", F.posexplode("held" if 1 in runs else "_pairs").alias("place", "lead"))


def _seeds(places: DataFrame, gaps: Sequence[int], runs: Sequence[int]) -> DataFrame:
    """One row per place and mask (or run of tokens) that fits in: its hash `seed`.

    A seed is the hash of two pair hashes, so each token costs one small hash per mask, whatever the mask's span.
    """
    place, pairs, held = F.col("place"), F.col("_pairs"), F.col("held")
    made = [F.when(place + gap < F.size(pairs), F.xxhash64(F.get(pairs, place), F.get(pairs, place + gap), F.lit(gap))) for gap in gaps]
    made += [F.when(place + length <= F.size(held), F.xxhash64(F.lit(-length), *[F.get(held, place + k) for k in range(length)]))
             for length in runs]
    return places.withColumn("seed", F.explode(F.array(*made))).where(F.col("seed").isNotNull())


def best_stretch(equal: Column, penalty: int = PENALTY) -> Column:
    """Struct(score, equal, first, last): the stretch of a boolean array with most trues, less `penalty` per false."""
    zero = F.lit(0)

    def step(state: Column, item: Column) -> Column:
        value = F.when(item["hit"], F.lit(1)).otherwise(F.lit(-penalty))
        fresh = state["run"] <= 0
        run = F.when(fresh, value).otherwise(state["run"] + value)
        same = F.when(fresh, zero).otherwise(state["run_equal"]) + F.when(item["hit"], 1).otherwise(0)
        start = F.when(fresh, item["place"]).otherwise(state["start"])
        better = run > state["score"]
        return F.struct(run.alias("run"), same.alias("run_equal"), start.alias("start"),
                        F.when(better, run).otherwise(state["score"]).alias("score"),
                        F.when(better, same).otherwise(state["equal"]).alias("equal"),
                        F.when(better, start).otherwise(state["first"]).alias("first"),
                        F.when(better, item["place"]).otherwise(state["last"]).alias("last"))

    names = ("run", "run_equal", "start", "score", "equal", "first", "last")
    start = F.struct(*[F.lit(-1 if name == "last" else 0).alias(name) for name in names])
    placed = F.transform(equal, lambda hit, i: F.struct(hit.alias("hit"), i.alias("place")))
    return F.aggregate(placed, start, step, lambda s: F.struct(
        s["score"].alias("score"), s["equal"].alias("equal"), s["first"].alias("first"), s["last"].alias("last")))


def short_runs(items: DataFrame, gaps: Sequence[int] = GAPS) -> list[int]:
    """Token numbers of items too short for any mask; such items are met as whole runs."""
    lengths = items.where(F.size("held") < min(gaps) + 2).select(F.size("held").alias("n")).distinct().collect()
    return sorted(row["n"] for row in lengths)  # fewer than the shortest mask


def overlaps(docs: DataFrame, benchmark: DataFrame, gaps: Sequence[int] = GAPS, min_tokens: int = MIN_TOKENS,
             min_equal: float = MIN_EQUAL, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per contaminated (doc_id, item_id): the best stretch, with its tokens, equal tokens and place.

    `docs(doc_id, text)`, `benchmark(item_id, text)`. A stretch counts from `min_tokens` equal tokens on, or all tokens of
    a shorter item. NULL and tokenless texts overlap with nothing; repeated rows give one row per pair; among equally
    good stretches the first in the document counts; rows without id carry NULL; extra columns are ignored.

    Up to `broadcast_rows` seeds the test set is broadcast and the documents stay where they are; the two tokens a
    seed begins with are looked up first. A larger test set is met by shuffles, with the same result.
    """
    items = save(benchmark.select("item_id", tokens(F.col("text")).alias("held")).where(F.size("held") > 0).distinct()
                 .withColumn("item_key", F.xxhash64("item_id", "held")), "items")
    runs = short_runs(items, gaps)
    seeds = save(_seeds(_positions(items.select("item_key", "held"), runs), gaps, runs)
                 .select("seed", "lead", "item_key", F.col("place").alias("item_place")), "seeds")
    marks = seeds.select("seed", "item_key", "item_place")
    named = items.select("item_key", "item_id", F.col("held").alias("item_tokens"))
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    # An item of n tokens has n / 5 seeds at least, so this bounds its tokens too: 40 bytes a seed, 24 without tokens.
    if seeds.count() <= broadcast_rows:
        held = docs.select("doc_id", tokens(F.col("text")).alias("held"))
        led = _positions(held, runs).join(F.broadcast(seeds.select("lead").distinct()), "lead", "left_semi")
        hits = (_seeds(led, gaps, runs).join(F.broadcast(marks), "seed").select("doc_id", "held", "item_key", shift)
                .join(F.broadcast(named), "item_key"))
    else:
        # Seeds travel without their texts; texts meet the diagonals found, each once, by id and hash.
        keyed = docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text")
        dealt = _seeds(_positions(keyed.select("doc_id", "_hash", tokens(F.col("text")).alias("held")), runs), gaps, runs)
        found = (spread_join(dealt.select("doc_id", "_hash", "seed", "place"), marks, ["seed"], ["doc_id", "place"])
                 .select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of"), "item_key", shift).distinct())
        met = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")))
        hits = spread_join(met.select("doc_id", tokens(F.col("text")).alias("held"), "item_key", "shift"), named, ["item_key"],
                           ["doc_id", "shift"])
    # The document's tokens under the item, clipped to the document, and where the item's first token would lie.
    shift = F.col("shift")
    low = F.greatest(shift, F.lit(0))
    span = F.least(F.size("held"), shift + F.size("item_tokens")) - low
    equal = F.zip_with(F.slice("held", low + 1, span), F.slice("item_tokens", low - shift + 1, span), lambda a, b: a == b)
    found = hits.select("doc_id", "item_id", low.alias("low"), F.size("item_tokens").alias("item_size"),
                        best_stretch(equal).alias("s"))
    length = F.col("s.last") - F.col("s.first") + 1
    good = found.where((F.col("s.equal") >= F.least(F.lit(min_tokens), F.col("item_size")))
                       & (F.col("s.equal") >= min_equal * length))
    best = (good.select("doc_id", "item_id", "item_size", F.struct(
                F.col("s.equal").alias("equal"), (F.col("s.equal") - length).alias("differing"),
                (-(F.col("low") + F.col("s.first"))).alias("first")).alias("stretch"))
            .groupBy("doc_id", "item_id", "item_size").agg(F.max("stretch").alias("best")))
    return best.select("doc_id", "item_id", F.col("best.equal").alias("equal_tokens"),
                       (F.col("best.equal") - F.col("best.differing")).alias("tokens"), (-F.col("best.first")).alias("first_token"),
                       F.round(F.col("best.equal") / F.col("item_size"), 4).alias("item_share"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of `docs` whose doc_id overlaps with no benchmark item; rows without doc_id stay.

    NULL and empty texts overlap with nothing; rows that repeat a doc_id stay or go together. Extra columns may have
    any names; an empty table stays empty, and an empty benchmark removes nothing.
    """
    hit = overlaps(docs.select("doc_id", "text"), benchmark, **options).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*[f"`{name}`" for name in docs.columns])
