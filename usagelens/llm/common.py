"""Helpers the text operators share: tables, tables cut from their lineage, training splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.session import scratch_path

# Fixed value: white space that separates words, written as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and go on from the written table.

    Cuts the lineage: a lost executor costs a new read of these files, never the work before them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; NULL for a missing id."""
    return F.crc32(doc_id.cast("string")) % buckets


def held_out(doc_id: Column, buckets: int, rest: int) -> Column:
    """True for the ids kept away from training; a missing id is never held out and never trained on."""
    return F.coalesce(bucket_of(doc_id, buckets) == rest, F.lit(False))


def trained_on(doc_id: Column, buckets: int, rest: int) -> Column:
    return F.coalesce(bucket_of(doc_id, buckets) != rest, F.lit(False))


def share_of_hash(key: Column, share: float, seed: int) -> Column:
    """True for about `share` of the keys, the same ones on every run."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(steps)) < F.lit(int(share * steps))


def chunks(sizes: np.ndarray, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded total size, so that a worker's arrays stay small whatever a batch holds.

    A range always has one row at least: one long text is handled whole, by itself.
    """
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and (held + size > most_bytes or at - start >= most_rows):
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
