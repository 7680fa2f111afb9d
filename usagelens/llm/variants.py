"""Spelling variants: words one edit apart, found by walking a trie that is a table.

The trie of all words is a table of edges (node, label, child), where nodes are prefixes at which words part
or end. Its frontier is a table of states (word, rest, node, edits): `node` is reached from the start of
`word` with so many edits and `rest` is still to be read. Each level joins the frontier once with the
edges: a state without an edit follows its own edge and also takes every other edge as a replaced, inserted
or deleted code point; a state with its edit only follows. States that have read everything and stand
on a word are neighbours.

Two words one edit apart agree before and after the edit, so the edit lies in the second half of the
word or, read backwards, in the second half of the reversed word. Both directions are walked in one
table; edits begin half-way down, where few edges leave a node. Edges also say how their child goes on, so
that a state which can't be read further is not written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import save

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
ERROR_EVERY = 31
HEAD = 4
_FLUSH = 200_000


def spoilt_runs(text: bytes, doc_id: str, least: int, every: int) -> list[bytes]:
    """Lower-cased runs of Latin-1 letters of at least `least` code points, every `every`-th without one of them."""
    start = zlib.crc32(f"{doc_id}:".encode())
    out = []
    for run in re.findall(rb"[a-z\xc0-\xff]{%d,}" % least, text.lower()):
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out.append(run)
    return out


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
          error_every: int = ERROR_EVERY) -> DataFrame:
    """(word, n) of all runs A-Z, a-z, U+00C0-U+00FF of the texts; only A-Z are lower-cased.

    A run whose crc32 of `<doc_id>:<run>` is a multiple of `error_every` loses one code point. NULL and empty
    texts have no runs; a missing doc_id is read as the empty string.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([word.decode("latin-1") for word in seen], pa.string()),
                                               pa.array(seen.values(), pa.int64())], ["word", "n"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                # Code points beyond Latin-1 end a run, as their stand-in does.
                seen.update(spoilt_runs((text.as_py() or "").encode("latin-1", "replace"), doc_id.as_py() or "",
                                        least_length, error_every))
                if len(seen) > _FLUSH:
                    yield flush()
                    seen.clear()
        yield flush()

    return (docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(tally, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def _built(rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, bool, str]]:
    """(node, label, ends, nexts) per edge below the heads, for (mark, strand) in order, all of a head together.

    `ends` and `nexts` say of the edge's child whether a strand ends there and with which code points it goes
    on. The row of a head itself has an empty label. Only the path of the last strand is held.
    """
    path: list[list] = []  # [depth, ends, nexts]
    last, mark = "", ""

    def close(down_to: int) -> Iterator[tuple[str, str, bool, str]]:
        while path and path[-1][0] > down_to:
            depth, ends, nexts = path.pop()
            if path and path[-1][0] < down_to:
                path.append([down_to, False, ""])
            if path:
                above = path[-1]
                above[2] += last[above[0]]
                yield mark + last[:above[0]], last[above[0]:depth], ends, nexts
            else:
                yield mark + last[:depth], "", ends, nexts

    for sign, strand in rows:
        head = min(HEAD, len(strand))
        same = path and sign == mark and last[:HEAD] == strand[:HEAD]
        common = len(commonprefix((last, strand))) if same else -1
        yield from close(common)
        if not path:
            path.append([head, len(strand) == head, ""])
        if len(strand) > path[-1][0]:
            path.append([len(strand), True, ""])
        last, mark = strand, sign
    yield from close(-1)


def trie(strands: DataFrame) -> DataFrame:
    """Edges (node, first, label, child, ends, nexts) of the trie of distinct `strands(mark, strand)`.

    A node is its prefix after the mark. Down to `HEAD` code points every prefix is a node; below, only those
    where strands part or end: at any other there is one way on and no edit can differ from it. `first`
    begins the label; `ends` and `nexts` describe the child.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((m, s) for batch in batches for m, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        edges = _built(rows)
        while part := list(islice(edges, 50_000)):
            node, label, ends, nexts = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label), pa.array(ends, pa.bool_()), pa.array(nexts)],
                                             ["node", "label", "ends", "nexts"])

    low = save(strands.select("mark", "strand").repartition("mark", F.expr(f"substring(strand, 1, {HEAD})"))
               .sortWithinPartitions("mark", "strand").mapInArrow(build, "node string, label string, ends boolean, nexts string"),
               "low")
    # Strands shorter than a head share their head with none but longer ones of another row: sum up what is known of a node.
    ways = low.where("label = ''").select("node", "ends", "nexts")
    edges = low.where("label <> ''").select("node", "label", F.concat("node", "label").alias("child"), "ends", "nexts")
    for _ in range(HEAD):
        ways = save(ways.groupBy("node").agg(F.max("ends").alias("ends"), F.concat_ws("", F.collect_set("nexts")).alias("nexts")),
                    "ways")  # a node has at most one way per code point
        up = ways.where("length(node) > 1").select(
            F.expr("substring(node, 1, length(node) - 1)").alias("node"), F.expr("substring(node, length(node))").alias("label"),
            F.col("node").alias("child"), "ends", "nexts")
        edges = edges.union(up)
        ways = up.select("node", F.lit(False).alias("ends"), F.col("label").alias("nexts"))
    return edges.distinct().withColumn("first", F.expr("substring(label, 1, 1)"))


def near_words(found: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of distinct words exactly one inserted, deleted or replaced code point apart."""
    half = F.expr("length(word) div 2")
    strands = found.select("word", F.lit(">").alias("mark"), F.col("word").alias("strand"), half.alias("start")).union(
        found.select("word", F.lit("<"), F.reverse("word"), F.length("word") - half))
    edges = save(trie(strands), "edges")
    ends = strands.select(F.concat("mark", "strand").alias("node"))
    # `wait`: code points still to be read before an edit may come.
    top = F.expr(f"least(start, {HEAD})")
    frontier = strands.select("word", F.expr(f"substring(strand, least(start, {HEAD}) + 1)").alias("rest"),
                              F.concat("mark", F.expr(f"substring(strand, 1, least(start, {HEAD}))")).alias("node"),
                              F.lit(0).alias("edits"), (F.col("start") - top).alias("wait"))
    # A last code point too many is deleted on the spot, where a word ends; all other edits take an edge.
    near = [frontier.where("wait <= 0 AND length(rest) = 1").join(ends, "node", "left_semi").select("word", "node")]
    depth = 1 + (frontier.agg(F.min(F.length("node") - 1)).first()[0] or 0)
    while True:
        # One join serves both kinds of states; a level goes at least one code point down, so edges above are left out.
        met = frontier.join(edges.where(F.length("node") >= depth), "node").select(
            "word", F.col("child").alias("node"), "ends", "nexts", "edits", F.expr("greatest(wait - length(label), 0)").alias("wait"),
            F.expr("edits = 0 AND wait <= 0").alias("open"), F.expr("startswith(rest, label)").alias("own"),
            *[F.expr(sql).alias(name) for name, sql in _EDITS.items()])
        edit = F.col("open") & ~F.col("own")
        taken = met.where("own OR (open AND coalesce(replaced, inserted, deleted) IS NOT NULL)").select(
            "word", "node", "wait", "ends", "nexts", F.inline(F.array(
                F.struct(F.when(F.col("own"), F.col("kept")).alias("rest"), "edits"),
                *[F.struct(F.when(edit, F.col(name)).alias("rest"), F.lit(1).alias("edits"))
                  for name in ("replaced", "inserted", "deleted")]))).where("rest IS NOT NULL")
        level = save(taken.select("word", "rest", "node", "edits", "wait", "ends", "nexts")
                     # What can neither end here nor go on is dropped at once.
                     .where("edits = 0 OR (rest = '' AND ends) OR (rest <> '' AND instr(nexts, substring(rest, 1, 1)) > 0)")
                     .drop("nexts"), "level")
        near.append(level.where("(edits = 1 AND rest = '') OR (edits = 0 AND wait <= 0 AND length(rest) = 1 AND ends)")
                    .select("word", "node"))
        frontier = level.where("edits = 0 OR rest <> ''").drop("ends")
        depth += 1
        if frontier.isEmpty():
            break
    every = near[0]
    for part in near[1:]:
        every = every.union(part)
    name = F.expr("substring(node, 2)")
    return every.select("word", F.when(F.col("node").startswith("<"), F.reverse(name)).otherwise(name).alias("near")).distinct()


# What is left of `rest` after reading `label` with an edit at its first code point, which differs from the strand's own.
_EDITS = {
    "kept": "substring(rest, length(label) + 1)",
    "replaced": "IF(rest <> '' AND startswith(substring(rest, 2), substring(label, 2)), substring(rest, length(label) + 1), NULL)",
    "inserted": "IF(startswith(rest, substring(label, 2)), substring(rest, length(label)), NULL)",
    "deleted": "IF(startswith(substring(rest, 2), label), substring(rest, length(label) + 2), NULL)",
}


def _best(n: Column, word: Column) -> Column:
    """Largest n first, then the smallest word: an order that `min` understands."""
    return F.min(F.struct((-n).alias("n"), word.alias("word")))


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                   times: int = TIMES, error_every: int = ERROR_EVERY) -> DataFrame:
    """One row per word of `docs(doc_id, text)`: word, n, n_near, form, form_n, root.

    NULL, empty and letterless texts add nothing; repeated rows count again; ties of n go to the word that is
    first in code-point order; extra columns are ignored; an empty table gives none.
    """
    found = save(words(docs, least_length, least_count, error_every), "words")
    near = save(near_words(found), "near")
    others = found.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near.join(others, "near").groupBy("word").agg(F.count("*").alias("n_near"),
                                                         _best(F.col("near_n"), F.col("near")).alias("best"))
    formed = -F.col("best.n") >= times * F.col("n")
    out = save(found.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"),
        F.when(formed, -F.col("best.n")).alias("form_n")), "forms")
    # Every step multiplies n, so chains are short; each round doubles the length that is resolved.
    chain = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = save(chain.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                            F.col("further").isNotNull().alias("moved")), "roots")
        chain = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return out.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                                                  "form_n")
