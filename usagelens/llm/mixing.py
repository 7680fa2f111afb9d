"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Targets are `least(cap, weight * level)`, with one level for all sources at which they add up to the wanted
total. With sources in the order of cap / weight, the level that would fit if all earlier sources stood at
their caps rises while sources are capped and falls afterwards, so the wanted level is its maximum: one pass
of running sums in place of repeated resharing.

A source takes every document `floor(target / size)` times as a whole; one more, fractional repetition takes
documents in a seeded order until the rest of the target is met, the last of them in part. Running sums are
cut into slices (`running_totals`), so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.joins import spread_join
from usagelens.functions.ordered import running_totals
from usagelens.llm.common import WORD, save

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
_KEY = ["no_source", "source_text"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame) -> list[Column]:
    """NULL sources as a key of their own that sorts last and joins like any other."""
    return [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_text")]


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`sizes(no_source, source_text, source_size)`, one row per source, plus `target`.

    Weights repeat over the sources in code point order, the NULL source last.
    """
    ranked = running_totals(sizes.withColumn("one", F.lit(1)), [], _KEY, ["one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("one_before", F.lit(len(weights))) + 1).cast("int"))
    asked = ranked.select(*_KEY, "source_size", weight.cast("long").alias("weight"),
                          (F.lit(max_epochs) * F.col("source_size")).alias("cap"))
    asked = asked.withColumn("turn", F.col("cap") / F.col("weight"))
    filled = save(running_totals(asked, [], ["turn", *_KEY], ["cap", "weight"]), "filled")
    wanted = F.lit(float(share)) * F.col("cap_all") / F.lit(max_epochs)
    level = filled.agg(F.max((wanted - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))).alias("level")).scalar()
    return filled.select(*_KEY, F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: str = SEED) -> DataFrame:
    """One row per row of `docs(doc_id, text, source)`: doc_id, size, source_size, target, whole, taken, source.

    NULL and wordless texts have size 0 and take 0; a NULL source is a source of its own; rows equal in
    doc_id, source and size take alike; rows without doc_id come last but one key apart in the seeded order.
    An empty table gives none. Extra columns are ignored.
    """
    rows = save(docs.select(*_keyed(docs), "doc_id", word_count(F.col("text")).alias("size"))
                .groupBy(*_KEY, "doc_id", "size").agg(F.count("*").alias("rows")), "sizes")
    sizes = save(rows.groupBy(*_KEY).agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), "sources")
    targets = source_targets(sizes, weights, share, max_epochs)

    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    ordered = running_totals(rows.select("*", turn.alias("turn"), (F.col("size") * F.col("rows")).alias("words")),
                             _KEY, ["turn", "doc_id", "size"], ["words"])
    dealt = spread_join(ordered, targets, _KEY, ["turn"])
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("words_all").cast("double"))), F.lit(0))
    rest = F.floor(F.col("target") - F.col("whole") * F.col("words_all"))
    part = F.greatest(F.lit(0), F.least(F.col("words"), rest - F.col("words_before")))
    return (dealt.withColumn("whole", whole)
            .withColumn("taken", F.col("whole") * F.col("size") + F.floor(part / F.col("rows")))
            .select("doc_id", "size", F.col("words_all").alias("source_size"), "target", "whole", "taken",
                    F.when(~F.col("no_source"), F.col("source_text")).alias("source"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_row"))
            .drop("_row"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: `docs` with one row per repetition, plus mix_repetition (from 1) and mix_words.

    The fractional repetition of a document holds its first words only as far as the source's target
    reaches; documents the mix does not take have no row. `n_chars`, where there is one, follows the text.
    """
    dealt = (mix(docs.select("doc_id", "text", "source"), **options).where(F.col("taken") > 0)
             .select("doc_id", "source", "size", "whole", "taken").distinct())
    left = docs.select(F.struct("*").alias("_doc"), word_count(F.col("text")).alias("_words")).alias("l")
    joined = left.join(dealt.alias("r"), (F.col("l._doc.doc_id").eqNullSafe(F.col("r.doc_id")))
                       & (F.col("l._doc.source").eqNullSafe(F.col("r.source"))) & (F.col("l._words") == F.col("r.size")))
    last = F.ceil(F.col("taken") / F.col("size")).cast("int")
    turns = joined.select("_doc", "size", "whole", "taken", F.explode(F.sequence(F.lit(1), last)).alias("_turn"))
    words = F.when(F.col("_turn") <= F.col("whole"), F.col("size")).otherwise(F.col("taken") - F.col("whole") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("_doc.text", F.lit(WORD), F.lit(0)), 1, F.col("_n").cast("int")), " ")
    text = F.when(F.col("_n") == F.col("size"), F.col("_doc.text")).otherwise(cut)
    made = turns.withColumn("_n", words)
    out = {name: F.col(f"_doc.`{name}`") for name in docs.columns}
    out["text"] = text
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast("long")
    out |= {"mix_repetition": F.col("_turn"), "mix_words": F.col("_n").cast("long")}
    return made.select(*[column.alias(name) for name, column in out.items()])
