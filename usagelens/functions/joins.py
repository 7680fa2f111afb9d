"""Joins that stay even when a few keys own much of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "_salt"


def spread_join(rows: DataFrame, table: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", salts: int | None = None, deal: bool = False) -> DataFrame:
    """Join rows to a table with one row per key, where single keys may own a large part of `rows`.

    Each key is split over `salts` buckets by a hash of `spread_by` (stable under task retries); the
    table is repeated once per bucket. By default twice the root of the session's shuffle partitions: a cluster with
    more tasks splits a key further, while copies grow more slowly than tasks. No broadcast hint: adaptive execution still switches to a
    broadcast when it has measured the table, with its copies, to be below the session's threshold.

    `deal` is for tables with many rows per key, where a few small files of `rows` become many times as many joined rows: the rows
    are dealt over all shuffle partitions by key and bucket first, however few bytes they are.
    """
    on = list(on)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts is None:
        salts = 2 * ceil(sqrt(partitions))
    split = rows.withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    if deal:
        split = split.repartition(partitions, *on, _SALT)
    # Copies by a join, since a generator's rows are estimated as if it made one row each: a table just below the broadcast
    # threshold would go to the driver and to all executors `salts` times.
    buckets = rows.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias(_SALT))
    copies = table.crossJoin(buckets)
    return split.join(copies, [*on, _SALT], how).drop(_SALT)
