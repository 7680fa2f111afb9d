"""Documents whose sets of word shingles overlap: an exact Jaccard join with several token orders.

If two sets are alike enough they share a token among the first few of each, in whatever order all
tokens are put. So a pair is a candidate only if it shares such a prefix token under every one of several
orders. All orders put rare tokens first, by a coarse frequency from a sketch of fixed size, and break ties by
different hashes; the sketch may be as wrong as it likes, an order is an order. The first order's prefixes
are joined. Bits that tell an even from an odd number of tokens each then reject pairs that must differ in too many tokens, the
prefixes of the other orders reject more, and only what passes is compared as a whole.

Equal sets are one representative from the start. Tokens that many sets have in their prefix would join all
pairs of them, so the join runs twice. First each set meets only its token's leader, the set in
which the token stands earliest: a group of near copies hangs together by its leaders. Then sets of one token
meet each other unless links have already brought them together, in blocks where there are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import save
from usagelens.llm.components import components

WIDTH = 3
PERCENT = 90
ORDERS = 3
BLOCK = 1024
_SLOT_BITS = 20
_SKETCH_BLOCK = 1 << 16
_FAN = 64
_BLOOM_BITS = 23
_KNOWN_WORDS = 200_000
_BATCH_TOKENS = 1 << 20
_PARITY_BITS = 1024


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, those of recent ones kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


_words = _Words()


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes; of the whole sequence when it is shorter; none without words."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    of = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    wide = min(width, len(words))
    rows = len(words) - wide + 1
    out = np.full(rows, wide, np.uint64)
    for k in range(wide):
        out = mixed(out + of[k:k + rows])
    return np.unique(out)


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """How many first tokens a set of n must look at: one more than it may lack."""
    return n - -(-percent * n // 100) + 1


def prefixes_of(tokens: np.ndarray, levels: np.ndarray, percent: int, orders: int) -> list[np.ndarray]:
    """The first tokens under each order, in that order: by frequency level, then by the order's own hash, then by token."""
    first, level = prefix_length(len(tokens), percent), levels[_slots(tokens)].astype(np.uint64) << np.uint64(56)
    out = []
    for order in range(orders):
        rank = level | (mixed(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (order + 1) % (1 << 64))) >> np.uint64(8))
        out.append(tokens[np.argsort(rank, kind="stable")[:first]])
    return out


def parities(tokens: np.ndarray) -> np.ndarray:
    """One bit for each of _PARITY_BITS shares of all tokens: whether the set holds an odd number of them.

    Two sets differ in at least as many tokens as these bits.
    """
    share = (mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(_PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(share, minlength=_PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Coarse frequency of each slot: 0 up to the usual fill, then two steps for each doubling."""
    usual = max(float(np.median(counts)), 1.0)
    return np.maximum(0, 2 * np.log2(np.maximum(counts, 1) / usual)).astype(np.uint8)


def _rows_and_sketch(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, place, key, n) per row, and the parts (block, part, counts) of the frequency sketch."""
    kind = dict(docs.dtypes)["doc_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(1 << _SLOT_BITS, np.int64), [], 0
        for batch in batches:
            keys, sizes = [], []
            for text in batch.column(2):
                tokens = shingle_set(text.as_py(), width)
                keys.append(set_key(tokens))
                sizes.append(len(tokens))
                waiting.append(_slots(tokens))
                held += len(tokens)
                if held >= _BATCH_TOKENS:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                    waiting, held = [], 0
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
        blocks = [k for k in range(0, len(counts), _SKETCH_BLOCK) if counts[k:k + _SKETCH_BLOCK].any()]
        n = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, schema_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
             pa.array([k // _SKETCH_BLOCK for k in blocks], pa.int32()),
             pa.array([TaskContext.get().partitionId()] * n, pa.int64()),
             pa.array([counts[k:k + _SKETCH_BLOCK].tobytes() for k in blocks], pa.binary())], names)

    names = ["doc_id", "place", "key", "n", "block", "part", "counts"]
    schema_type = docs.select("doc_id").limit(0).toArrow().schema.types[0]
    both = save(docs.select("doc_id", F.xxhash64("text").alias("place"), F.col("text").cast("binary"))
                .mapInArrow(read, f"doc_id {kind}, place long, key binary, n long, block int, part long, counts binary"), "rows")
    return both.where("block is null").select(*names[:4]), both.where("block is not null").select(*names[4:])


def _summed(parts: DataFrame) -> np.ndarray:
    """The whole sketch, added up in a tree of tasks; its size is fixed."""
    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(_SKETCH_BLOCK, np.int64)
        for counts in table["counts"]:
            total += np.frombuffer(counts.as_py(), np.int64)
        return pa.table({"block": [key[0].as_py()], "part": [key[1].as_py()], "counts": [total.tobytes()]},
                        pa.schema([("block", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())]))

    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = save(parts.select("block", F.expr(f"part div {_FAN}").alias("part"), "counts")
                     .groupBy("block", "part").applyInArrow(add, "block int, part long, counts binary"), "sketch")
        most //= _FAN
        if not most:
            break
    counts = np.zeros(1 << _SLOT_BITS, np.int64)
    for row in parts.toLocalIterator():
        counts[row["block"] * _SKETCH_BLOCK:][:_SKETCH_BLOCK] = np.frombuffer(row["counts"], np.int64)
    return counts


def _prefixes(docs: DataFrame, levels: np.ndarray, width: int, percent: int, orders: int) -> DataFrame:
    """(key, n, tokens, more, odd): the first order's prefix, short hashes of the others' and parities, once per set and task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), width)
                key = set_key(tokens)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    first, *others = prefixes_of(tokens, shared.value, percent, orders)
                    out.append((key, len(tokens), first.view(np.int64), [x.astype(np.uint32).view(np.int32) for x in others],
                                parities(tokens)))
            keys, sizes, firsts, more, odd = zip(*out) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                 pa.array(more, pa.list_(pa.list_(pa.int32()))), pa.array(odd, pa.list_(pa.int64()))], ["key", "n", "tokens", "more", "odd"])

    return (docs.select(F.col("text").cast("binary"))
            .mapInArrow(read, "key binary, n long, tokens array<long>, more array<array<int>>, odd array<long>"))


def _possible(percent: int, a: str, b: str) -> Column:
    """Whether two sets whose first common token has these places can still be alike: by their sizes and by what is left."""
    need = f"(({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent})"
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND "
                  f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need}")


def _close(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parities do not prove that they differ in too many tokens."""
    odd = prefixes.select("rep", F.struct("n", "odd").alias("own"))
    both = (pairs.join(odd.select(F.col("rep").alias("a"), F.col("own").alias("of_a")), "a")
            .join(odd.select(F.col("rep").alias("b"), F.col("own").alias("of_b")), "b"))
    differ = F.aggregate(F.zip_with("of_a.odd", "of_b.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return both.where(differ * (100 + percent) <= (F.col("of_a.n") + F.col("of_b.n")) * (100 - percent)).select("a", "b")


def _sharing(pairs: DataFrame, prefixes: DataFrame, percent: int, orders: int) -> DataFrame:
    """Pairs that also share a prefix token under all other orders."""
    pairs = save(_close(pairs, prefixes, percent), "close")
    if orders < 2:
        return pairs
    more = prefixes.select("rep", "more")
    both = (pairs.join(more.select(F.col("rep").alias("a"), F.col("more").alias("more_a")), "a")
            .join(more.select(F.col("rep").alias("b"), F.col("more").alias("more_b")), "b"))
    for order in range(orders - 1):
        both = both.where(F.arrays_overlap(F.col("more_a")[order], F.col("more_b")[order]))
    return both.select("a", "b")


def _bloom(places: DataFrame) -> np.ndarray:
    """Bits of all `places`, 2 ** _BLOOM_BITS in all. More places only let more texts through."""
    bit = F.pmod(F.xxhash64("place"), F.lit(1 << _BLOOM_BITS))
    words = (places.select(F.expr(f"{1 << _BLOOM_BITS} - 1").alias("top"), bit.alias("bit"))
             .select(F.expr("bit div 63").alias("word"), F.expr("shiftleft(1L, cast(bit % 63 as int))").alias("value"))
             .groupBy("word").agg(F.bit_or("value").alias("value"))).toArrow()
    out = np.zeros((1 << _BLOOM_BITS) // 63 + 1, np.int64)
    out[words["word"].to_numpy()] = words["value"].to_numpy()
    return out


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, n, tokens) of the representatives in `wanted(rep, key, place)`; texts that can't be meant are not sent on."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            bit = batch.column(0).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((bloom.value[bit // 63] >> (bit % 63)) & 1)
            out = []
            for text in batch.column(1).take(pa.array(hit)):
                tokens = shingle_set(text.as_py(), width)
                key = set_key(tokens)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    out.append((key, tokens.view(np.int64)))
            keys, sets = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "tokens"])

    bit = F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(1 << _BLOOM_BITS))
    sets = docs.select(bit.alias("bit"), F.col("text").cast("binary")).mapInArrow(read, "key binary, tokens array<long>")
    return (sets.join(wanted.select("rep", "key"), "key").groupBy("rep").agg(F.first("tokens").alias("tokens")))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are alike."""
    named = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = save(reps.join(named, "rep").select("rep", "key", "place"), "wanted")
    sets = save(_whole_sets(docs, wanted, width), "sets")
    both = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("set_a")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("set_b")), "b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _met_leaders(shared: DataFrame, percent: int) -> DataFrame:
    """Each set with the leader of each of its prefix tokens."""
    met = shared.select(F.struct("rep", "n", "pos").alias("x"), F.col("lead").alias("y")).where("x.rep <> y.rep")
    return met.where(_possible(percent, "x", "y")).select(
        F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _met_others(shared: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Sets of one token that no link has brought together, except for the leader, which has met all of them."""
    known = shared.where("rep <> lead.rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    open_tokens = known.groupBy("token").agg(
        F.count("*").alias("rows"), F.count("label").alias("labelled"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).where("rows > 1 AND (rows > labelled OR lo <> hi)").select(
        "token", F.expr(f"cast((rows + {block} - 1) div {block} as int)").alias("blocks"))
    known = save(known.join(open_tokens, "token").select("token", "blocks", "rep", "n", "pos", "label"), "open")
    # The smaller set of a pair needs an even shorter prefix.
    small = known.where(F.expr(f"pos <= n - ((2 * {percent} * n + {99 + percent}) div {100 + percent})")).select(
        "token", F.expr("cast(pmod(xxhash64(rep), blocks) as int)").alias("block"), F.struct("rep", "n", "pos", "label").alias("x"))
    large = known.select("token", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
                         F.struct("rep", "n", "pos", "label").alias("y"))
    ordered = F.expr("(x.n < y.n OR (x.n = y.n AND x.rep < y.rep)) AND NOT coalesce(x.label = y.label, false)")
    return (small.join(large, ["token", "block"]).where(ordered & _possible(percent, "x", "y"))
            .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS,
                   block: int = BLOCK) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, n_shingles, component_id.

    component_id is the least doc_id that links lead to. NULL and wordless texts have empty sets and are groups
    of their own; repeated rows each get their row; rows without doc_id take part but never name a group (NULL
    if no member has an id); extra columns are ignored; an empty table gives none. Shingles are compared by
    64-bit hashes, whole sets by 128-bit digests.
    """
    docs = docs.select("doc_id", "text")
    rows, parts = _rows_and_sketch(docs, width)
    levels = levels_of(_summed(parts))
    grouped = save(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("place").alias("place")), "keys")
    reps = save(grouped.withColumn("rep", F.monotonically_increasing_id()), "reps")
    prefixes = save(_prefixes(docs, levels, width, percent, orders).join(reps.select("key", "rep"), "key")
                    .groupBy("rep").agg(*[F.first(name).alias(name) for name in ("n", "tokens", "more", "odd")]), "prefixes")
    postings = prefixes.select("rep", "n", F.posexplode("tokens").alias("pos", "token"))
    leads = (postings.groupBy("token").agg(F.min(F.struct("pos", "rep", "n")).alias("lead"), F.count("*").alias("held"))
             .where("held > 1").select("token", "lead"))
    shared = save(postings.join(leads, "token"), "shared")

    met = save(_sharing(_met_leaders(shared, percent), prefixes, percent, orders), "candidates")
    links = save(_verified(met, docs, reps, width, percent), "links")
    met = save(_sharing(_met_others(shared, components(links), percent, block), prefixes, percent, orders), "candidates")
    links = links.union(_verified(met, docs, reps, width, percent))

    groups = components(links).select(F.col("node").alias("rep"), "label")
    linked = reps.join(groups, "rep")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "label").select("key", "component_id")
    single = reps.join(groups, "rep", "left_anti").select("key", F.col("first_id").alias("component_id"))
    # Documents without words have no representative and name themselves.
    own = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(named.unionAll(single), "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(own)
