"""Connected components of a link table by repeated contraction.

Each round gives every node the least hashed id among itself and its neighbours and rewrites the links
between those new ids; links inside a group vanish. The hash is new in each round, so chains shrink
by a constant share instead of one step. Only the question whether links are left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """`links(a, b)` of longs to `(node, label)`: one row per linked node, one label per component.

    Labels are 64-bit hashes that mean nothing beyond equality. Loops and NULLs are ignored; a node
    without a link to another node has no row.
    """
    spark = links.sparkSession
    left = save(_distinct(links.select("a", "b")), "links")
    found = spark.createDataFrame([], "node long, label long")
    turn = 0
    while not left.isEmpty():
        ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = save(ends.groupBy(F.col("a").alias("node")).agg(F.min(F.xxhash64("b", F.lit(turn))).alias("least"))
                    .select("node", F.least("least", F.xxhash64("node", F.lit(turn))).alias("label")), "step")
        new_a = step.select(F.col("node").alias("a"), F.col("label").alias("na"))
        new_b = step.select(F.col("node").alias("b"), F.col("label").alias("nb"))
        left = save(_distinct(left.join(new_a, "a").join(new_b, "b")
                              .select(F.col("na").alias("a"), F.col("nb").alias("b"))), "links")
        if turn == 0:
            found = step
        else:
            later = step.select(F.col("node").alias("label"), F.col("label").alias("new_label"))
            found = save(found.join(later, "label", "left")
                         .select("node", F.coalesce("new_label", "label").alias("label")), "labels")
        turn += 1
    return found


def _distinct(links: DataFrame) -> DataFrame:
    return (links.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
