"""URL rules with exact membership from a cascade of Bloom filters.

A rule (action, host, path) fits a url whose host is the rule's or a subdomain and whose path starts with the rule's; its key
is host and path in one text. A url's possible keys are its host's suffixes times the path beginnings of the lengths
that occur in rules. All possible keys of the corpus are the key universe.

Per action, level 1 of the cascade encodes the listed keys, level 2 those other keys of the universe that level 1 lets
through, level 3 the listed keys that level 2 lets through, and so on until nothing slips through. For any key of the
universe the first level that refuses it decides, so the answer is exact and needs no join with the list. Levels are
built by Spark; together they take a few bits per listed key and at most `MAX_BYTES`, else building fails.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import save

Rule = tuple[str, str, str]  # action, host, path

# The rules of the registered query.
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
FALSE_RATE = 0.02
MAX_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def possible_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys a url could be listed under, longest first; among equally long ones the longer host first."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda n: F.struct(
        (-(F.length(h) + n)).alias("order"), (-F.length(h)).alias("host"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """One of many independent 64-bit hashes of 64-bit hashes."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class Level:
    """A Bloom filter of hashed keys."""

    salt: int
    hashes: int
    words: np.ndarray

    @property
    def bits(self) -> int:
        return 64 * len(self.words)

    def places(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        return np.stack([_mixed(keys, 64 * self.salt + i + 1) % np.uint64(self.bits) for i in range(self.hashes)])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = self.places(keys)
        return ((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1).all(axis=0)


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, keys: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe the cascade was built over."""
        inside = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for turn, level in enumerate(self.levels):
            passed = level.holds(keys[left])
            if turn % 2:  # refused by a level of false positives: listed
                inside[left[~passed]] = True
            left = left[passed]
        if len(self.levels) % 2:
            inside[left] = True
        return inside


def build_level(keys: DataFrame, count: int, salt: int, rate: float) -> Level:
    bits = max(64, ceil(count * -log(rate) / log(2) ** 2 / 64) * 64)
    if bits > 8 * MAX_BYTES:
        raise ValueError(f"a level for {count} keys takes {bits // 8} bytes, more than {MAX_BYTES}")
    level = Level(salt, max(1, round(bits / max(count, 1) * log(2))) if count * 64 > bits else 7, np.zeros(bits // 64, np.uint64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(level.places(batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["word", "bits"])

    for row in keys.mapInArrow(encode, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        level.words[row["word"]] = np.int64(row["bits"]).astype(np.uint64)
    return level


def build_cascade(universe: DataFrame, listed: DataFrame, rate: float = FALSE_RATE) -> Cascade:
    """`universe(key long)` and `listed(key long)`, both distinct, to a cascade that is exact on the universe."""
    cascade = Cascade([])
    # Keys still in question on the side to encode and on the other side.
    encode, other = save(listed, "listed"), universe.join(listed, "key", "left_anti")
    while (count := encode.count()) > 0:
        level = build_level(encode, count, len(cascade.levels), rate if not cascade.levels else 0.5)
        cascade.levels.append(level)

        def slipped(batches: Iterator[pa.RecordBatch], level: Level = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys[level.holds(keys)])], ["key"])

        encode, other = save(other.mapInArrow(slipped, "key long"), "slipped"), encode
    return cascade


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT) -> DataFrame:
    """One row per row of `pages(page_id, url)`: page_id, host, path, rule (its key, else NULL), verdict.

    The longest fitting rule decides, among equally long ones that of the longer host; without one the verdict is
    `default`. A NULL url or one without `://` has an empty host and path, which fit a rule without host alone.
    Repeated rows give repeated answers; extra columns are ignored; an empty table gives none.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted({len(path) for *_, path in rules}) or [0]  # as many as rules at most
    keyed = urls.withColumn("keys", possible_keys(F.col("host"), F.col("path"), lengths))
    universe = save(keyed.select(F.explode("keys").alias("k")).select(F.xxhash64("k").alias("key")).distinct(), "universe")
    actions = sorted({action for action, *_ in rules})
    cascades = []
    for action in actions:
        texts = sorted({(host + path,) for act, host, path in rules if act == action})
        listed = spark.createDataFrame(texts, "k string").select(F.xxhash64("k").alias("key")).distinct()
        cascades.append(build_cascade(universe, listed))

    @F.pandas_udf("place int, action string")
    def find(hashes: pd.Series) -> pd.DataFrame:
        """1-based place of the first listed key, and its action; 0 without one."""
        sizes = np.array([len(h) for h in hashes], np.int64)
        keys = np.concatenate([*hashes, np.empty(0, np.int64)]).astype(np.int64)
        which = np.full(len(keys), -1)
        for number, cascade in enumerate(cascades):
            which[cascade.listed(keys)] = number
        place, action = np.zeros(len(sizes), np.int32), np.full(len(sizes), None, object)
        row = np.repeat(np.arange(len(sizes)), sizes)
        hit = np.flatnonzero(which >= 0)[::-1]
        place[row[hit]] = (hit - (np.cumsum(sizes) - sizes)[row[hit]] + 1)  # the first one is written last
        action[row[hit]] = np.array(actions, object)[which[hit]] if len(hit) else None
        return pd.DataFrame({"place": place, "action": action})

    found = keyed.withColumn("found", find(F.transform("keys", lambda k: F.xxhash64(k))))
    return found.select("page_id", "host", "path", F.when(F.col("found.place") > 0, F.get("keys", F.col("found.place") - 1)).alias("rule"),
                        F.coalesce("found.action", F.lit(default)).alias("verdict"))
