"""Document fingerprints: a Merkle tree over sections, paragraphs and spans of a few words.

A text is cut into sections (at blank lines), sections into paragraphs (at line ends) and paragraphs into spans of
`SPAN` words; every byte belongs to one span. Span digests are hashed into paragraph digests, those into section
digests, those into the root: equal roots mean equal texts, and going down where digests differ locates an edit.

The fingerprint string is the root and, after a colon, the digests of all spans, eight hex digits each, with `,`
between paragraphs and `;` between sections. Likeness of two fingerprints is the share of span digests they have in
common: 2 * common / (all of one + all of the other). It is taken from what the strings hold (`string_likeness` gives it from
two strings alone); the tree itself hashes whole digests.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from usagelens.functions import ordered

SPAN = 5
KEPT = 4  # bytes of a span's digest that the string holds
# A span: blanks before a word belong to it, blanks after the last word of a paragraph too.
_SPANS = re.compile(rb"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){1,%d}(?:[\x20\x09-\x0D]+\Z)?|[\x20\x09-\x0D]+\Z" % SPAN)
_SECTION_END = re.compile(rb"\n[\x20\x09\r]*\n")


class Tree:
    """Digests of one text: `root`, and span digests by section and paragraph."""

    def __init__(self, text: bytes):
        self.sections: list[list[list[bytes]]] = []
        digest, start = xxhash.xxh3_64_digest, 0
        for end in [*(match.end() for match in _SECTION_END.finditer(text)), len(text)]:
            if end > start or not self.sections:
                self.sections.append([[digest(span) for span in _SPANS.findall(line)]
                                      for line in text[start:end].splitlines(keepends=True)])
            start = end
        self.root = _above([_above([_above(p) for p in section]) for section in self.sections])

    def __str__(self) -> str:
        return self.root.hex() + ":" + ";".join(
            ",".join(b"".join([span[:KEPT] for span in p]).hex() for p in section) for section in self.sections)

    def spans(self) -> Counter:
        """The span digests as the string holds them."""
        return Counter(span[:KEPT] for section in self.sections for p in section for span in p)

    def differing(self, other: Tree) -> list[tuple[int, int]]:
        """(section, paragraph) of the branches in which two trees differ, found from the roots down."""
        if self.root == other.root:
            return []
        return [(i, j) for i, (left, right) in enumerate(zip_longest(self.sections, other.sections, fillvalue=[])) if left != right
                for j, (p, q) in enumerate(zip_longest(left, right)) if p != q]


def _above(children: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16).digest()


def likeness(a: Counter, b: Counter) -> float:
    """Share of common spans; two texts without any span are alike."""
    total = a.total() + b.total()
    if not total:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return 2 * sum(min(n, large[span]) for span, n in small.items() if span in large) / total


def string_likeness(a: str, b: str) -> float:
    """Likeness of two fingerprint strings."""
    def spans(fingerprint: str) -> Counter:
        digests = bytes.fromhex(fingerprint.partition(":")[2].replace(",", "").replace(";", ""))
        return Counter(digests[i:i + KEPT] for i in range(0, len(digests), KEPT))
    return likeness(spans(a), spans(b))


def edits(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """(section, paragraph) of the branches in which two texts differ."""
    return Tree(a).differing(Tree(b))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following one, or all it has."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` dealt for a walk in descending doc_id: columns doc_id, text, part, tail.

    Each part holds a range of ids, in order, and after them a copy (tail 1) of the row that follows in the next
    part. All texts are shuffled once, and only one row per part is copied. Rows without doc_id come last, in an
    order of their texts' hashes. Ranges are cut at approximate quantiles; there are four times as many as
    shuffle partitions, so that tasks get about even shares.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text", F.col("doc_id").alias("place"))
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):  # other ids are placed by their rank
        ranks = ordered.dense_codes(docs.where(F.col("doc_id").isNotNull()), "doc_id", "rank")
        docs = docs.join(ranks, "doc_id", "left").select("doc_id", "text", F.col("rank").alias("place"))
    key = F.coalesce(F.col("place").cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    keyed = docs.select("doc_id", "text", key.alias("key"))
    asked = [i / parts for i in range(1, parts)]
    cuts = np.unique(np.array(keyed.agg(F.percentile_approx("key", asked, 10 * parts)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype(np.int32))

    # At most one row per part reaches the driver: the largest key, which follows the part above.
    tops = {row["part"]: row["top"] for row in
            keyed.select("key", part_of("key").alias("part")).groupBy("part").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    above = {tops[below]: part for part, below in zip(order, [*order[1:], *order[:1]])}
    copied, target = np.array(sorted(above), np.int64), np.array([above[k] for k in sorted(above)], np.int32)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy()
        own = np.searchsorted(cuts, values, side="right")
        at = np.minimum(np.searchsorted(copied, values), max(len(copied) - 1, 0))
        return pd.Series([[p, target[i]] if copied[i] == v else [p] for p, i, v in zip(own, at, values)], dtype=object)

    dealt = keyed.select("doc_id", "text", "key", F.posexplode(places("key")).alias("tail", "part"))
    return (dealt.repartition("part").sortWithinPartitions("part", "tail", F.col("key").desc(), F.xxhash64("text"))
            .select("doc_id", "text", "part", "tail"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: its fingerprint, that of its edited text, and how alike they are.

    The edited text takes its end from the next document in descending doc_id (`edited`, `with_next`); after the last
    comes the first. `n_branches` paragraphs of the tree differ between the two, the first one is `first_branch`
(section.paragraph, from 0; NULL if none differs). NULL and empty texts are the empty text: no spans, one fingerprint, likeness 1 to each other and 0
    to all else. Repeated ids and rows follow each other in the order of their texts' hashes; rows without doc_id come
    after all others; extra columns are ignored; an empty table gives none, and a single row follows itself.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, n_branches long, first_branch string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part, waiting, made, held = None, None, [], 0

        def flush() -> pa.RecordBatch:
            names = [piece.split()[0] for piece in schema.split(", ")]
            kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
                     pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text, part, tail in zip(*(column.to_pylist() for column in batch.columns)):
                text = text or ""
                if open_part != part:
                    open_part, waiting = part, None
                if tail and waiting is None:
                    continue
                tree = Tree(text.encode())
                spans = tree.spans()
                if waiting is not None:
                    made.append(_described(*waiting, text, spans))
                    held += len(waiting[1])
                waiting = None if tail else (doc_id, text, tree, spans)
                if held > 4 << 20 or len(made) >= 1000:
                    yield flush()
                    made, held = [], 0
        if made:
            yield flush()

    return with_next(docs.select("doc_id", "text")).mapInArrow(walk, schema)


def _described(doc_id, text: str, tree: Tree, spans: Counter, next_text: str, next_spans: Counter) -> tuple:
    changed = edited(text, next_text).encode()
    changed_tree = Tree(changed)
    branches = tree.differing(changed_tree)
    return (doc_id, len(text), hashlib.sha256(changed).hexdigest(), str(tree), str(changed_tree),
            likeness(spans, changed_tree.spans()), likeness(spans, next_spans), len(branches),
            "%d.%d" % branches[0] if branches else None)
