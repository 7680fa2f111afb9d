"""Near-duplicates by SimHash: fingerprints, vantage-point trees, linked groups.

A fingerprint holds, per bit, the majority of the hashes of a text's word shingles. Two fingerprints
link when they differ in few bits. Pairs are found with vantage-point trees: a pair of at most k bits
differs in at most k // 2 bits in one 32-bit half, so there is one tree per half, with that smaller
radius r. Each inner node splits the points by distance to a pivot, d <= t or d > t. By the triangle
inequality partners lie within r of each other's distance, so copying the points with t - r < d <= t
over to the far side brings every pair together in some shard; with r = 1 that is one distance value
per level. Shards are searched by the same splits in memory, on whole fingerprints.

The top of each tree comes from a bounded sample of fingerprints (`ROUTER_SAMPLE`). It only decides
which shard a point goes to; every tree, even one made of bad pivots, gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import save, share_of_hash
from usagelens.llm.components import components

MAX_BITS = 3
SHINGLE = 3
SEED = 42
ROUTER_SAMPLE = 1 << 18
SHARD_POINTS = 4096
SMALL = 512
_HALVES = ((0, 0xFFFFFFFF), (32, 0xFFFFFFFF))


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; of the whole text when it is shorter."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate(len(word) + 1 for word in words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e - 1], seed) for s, e in zip([0, *ends], ends[width - 1:])),
                       np.uint64, len(words) - width + 1)


def fingerprint_of(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingle hashes, as a signed long; 0 without words."""
    hashes = shingle_hashes(text or b"", width, seed)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = SHINGLE, seed: int = SEED) -> Column:
    """SimHash of a text column as a long; NULL and wordless texts give 0."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(value, width, seed) for value in batch], dtype="int64")
    return of(text.cast("binary"))


def hex_fingerprint(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


class Router:
    """The top of a vantage-point tree over one half of the fingerprints.

    Inner node i holds a pivot, a threshold and its two children; a negative child -k-1 is shard k.
    """

    def __init__(self, sample: np.ndarray, half: int, radius: int, depth: int, least: int = 8):
        self.half, self.radius = half, radius
        self.pivot: list[int] = []
        self.threshold: list[int] = []
        self.children: list[list[int]] = []
        self.shards = 0
        self.root = self._build(np.unique(self.part(sample)), depth, least, np.random.default_rng(half))

    def part(self, points: np.ndarray) -> np.ndarray:
        shift, mask = _HALVES[self.half]
        return (points >> np.uint64(shift)) & np.uint64(mask)

    def _build(self, points: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> int:
        split = best_split(points, self.radius, rng) if depth > 0 and len(points) >= 2 * least else None
        if split is None:
            self.shards += 1
            return -self.shards
        pivot, threshold, distance = split
        node = len(self.pivot)
        self.pivot.append(int(pivot))
        self.threshold.append(int(threshold))
        self.children.append([0, 0])
        self.children[node][0] = self._build(points[distance <= threshold], depth - 1, least, rng)
        self.children[node][1] = self._build(points[distance > threshold - self.radius], depth - 1, least, rng)
        return node

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions) for a batch: every shard in which a partner may wait, found by bounds."""
        part, todo = self.part(points), [(self.root, np.arange(len(points)))]
        while todo:
            node, held = todo.pop()
            if not len(held):
                continue
            if node < 0:
                yield -node - 1, held
                continue
            distance = np.bitwise_count(part[held] ^ np.uint64(self.pivot[node])).astype(np.int16)
            near, far = self.children[node]
            todo.append((near, held[distance <= self.threshold[node]]))
            todo.append((far, held[distance > self.threshold[node] - self.radius]))


def best_split(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 6):
    """The pivot and threshold that cut the points evenly with few of them on the boundary."""
    best, n = None, len(points)
    for pivot in rng.choice(points, min(tries, n), replace=False):
        distance = np.bitwise_count(points ^ pivot).astype(np.int16)
        upto = np.cumsum(np.bincount(distance, minlength=65))
        for threshold in range(int(distance.min()), int(distance.max())):
            near, before = int(upto[threshold]), int(upto[threshold - radius]) if threshold >= radius else 0
            worst = max(near, n - before)
            if worst < n and (best is None or worst < best[0]):
                best = worst, pivot, threshold, distance
    return None if best is None else best[1:]


def linked_pairs(points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) that join all points within `max_bits` of each other, group by group.

    Not all pairs: points of one group are joined by as few pairs as keep it in one piece.
    """
    rng, heads, tails = np.random.default_rng(1), [], []
    todo = [np.arange(len(points))]
    while todo:
        held = todo.pop()
        split = best_split(points[held], max_bits, rng) if len(held) > SMALL else None
        if split is not None and _worth(split, len(held), max_bits):
            _, threshold, distance = split
            todo.append(held[distance <= threshold])
            todo.append(held[distance > threshold - max_bits])
            continue
        for a, b in _by_blocks(points[held], max_bits):
            heads.append(held[a])
            tails.append(held[b])
    if not heads:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(len(points), np.concatenate(heads), np.concatenate(tails))


def _worth(split, size: int, max_bits: int) -> bool:
    """Whether both sides are clearly smaller; else comparing all is the cheaper exact way."""
    _, threshold, distance = split
    return max((distance <= threshold).sum(), (distance > threshold - max_bits).sum()) < 0.9 * size


def _by_blocks(points: np.ndarray, max_bits: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(points), block):
        for j in range(i, len(points), block):
            close = np.bitwise_count(points[i:i + block, None] ^ points[None, j:j + block]) <= max_bits
            a, b = np.nonzero(np.triu(close, 1) if i == j else close)
            if len(a):
                yield _forest(2 * block, a, b + (block if i != j else 0), shift=(i, j, block))


def _forest(n: int, a: np.ndarray, b: np.ndarray, shift: tuple[int, int, int] | None = None):
    """The same groups, as one pair (point, least point of its group) per point."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    inner = np.flatnonzero(label != np.arange(n))
    root = label[inner]
    if shift is None:
        return inner, root
    i, j, block = shift
    place = lambda x: np.where(x < block, x + i, x - block + j)
    return place(inner), place(root)


def near_links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """`points(fp long)`, distinct, to links `(a, b)` whose groups are those of all pairs within max_bits."""
    radius, spark = max_bits // 2, points.sparkSession
    total = points.count()
    share = min(1.0, 0.9 * ROUTER_SAMPLE / max(total, 1))
    picked = points.where(share_of_hash(F.col("fp"), share, 7)).limit(ROUTER_SAMPLE).toArrow()
    sample = picked["fp"].to_numpy().view(np.uint64) if picked.num_rows else np.empty(0, np.uint64)
    depth = ceil(log2(max(total / SHARD_POINTS, 1)))
    # Two small trees of at most ROUTER_SAMPLE / 8 nodes travel with the tasks.
    routers = [Router(sample, half, radius, depth) for half in (0, 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for tree, router in enumerate(routers):
                parts = list(router.route(fp.view(np.uint64)))
                if parts:
                    shard = np.concatenate([np.full(len(held), 2 * k + tree, np.int64) for k, held in parts])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard), pa.array(fp[np.concatenate([held for _, held in parts])])], ["shard", "fp"])

    def search(shard: pa.Table) -> pa.Table:
        fp = np.unique(shard["fp"].to_numpy().view(np.uint64))
        a, b = linked_pairs(fp, max_bits)
        return pa.table({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    return (points.select("fp").mapInArrow(deal, "shard long, fp long")
            .groupBy("shard").applyInArrow(search, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, fp (long), component_id.

    component_id is the least doc_id that links lead to. NULL and wordless texts have fingerprint 0 and
    link like any other; repeated rows each get their row; rows without doc_id take part but never
    name a component (NULL if no member has an id). Extra columns are ignored; an empty table gives none.
    """
    rows = save(docs.select("doc_id", fingerprint(F.col("text"), width, seed).alias("fp")), "fingerprints")
    first = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    groups = components(near_links(first.select("fp"), max_bits)).select(F.col("node").alias("fp"), "label")
    # Linked fingerprints are grouped by label; all others are groups of their own.
    linked = first.join(groups, "fp")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "label").select("fp", "component_id")
    single = first.join(groups, "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    return rows.join(named.unionAll(single), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs` without those whose group holds a smaller doc_id; all columns stay as they are.

    A repeated doc_id stays if any of its rows names its group. Rows without doc_id stay. NULL and wordless texts are
    one group. Extra columns may have any names; an empty table stays empty.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), **options)
    dropped = (groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
               .agg(F.max(F.col("doc_id") == F.col("component_id")).alias("names"))
               .where(~F.col("names")).select("doc_id"))
    return docs.join(dropped, "doc_id", "left_anti").select(*[f"`{name}`" for name in docs.columns])
