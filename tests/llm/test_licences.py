"""Operator 10: the unknown class and its threshold come from every paragraph of the corpus."""

import random
import re

from pyspark.sql import functions as F

from usagelens.llm import licences
from usagelens.llm.common import share_of_hash

NOTICE = "All rights reserved."


def pair_set(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return set(zip(words, words[1:]))


def nearest(text):
    """The largest share of word pairs in common with a template, in plain Python."""
    own, best = pair_set(text), 0.0
    for templates in licences.TEMPLATES.values():
        for held in map(pair_set, templates):
            best = max(best, len(own & held) / max(min(len(own), len(held)), 2))
    return best


def test_every_paragraph_teaches_the_unknown_class(spark, documents):
    n = 2500
    # Of 2,500 documents, those that a bounded sample by id (2,000 paragraphs' worth) used to leave out.
    left_out = {row["id"] for row in spark.range(1, n).where(~share_of_hash(F.col("id"), 2000 / n, 17)).collect()}
    assert len(left_out) > 300
    plain = [(i, f"a plain line of prose with number {i}") for i in range(1, n)]
    alike = [(i, "rights to all seats are reserved by post" if i in left_out else text) for i, text in plain]

    def chance(rows):
        found = licences.scan(documents((0, NOTICE), *rows)).collect()
        assert [(r["doc_id"], r["family"]) for r in found] == [(0, "reserved")]
        return found[0]["probability"]

    assert chance(alike) != chance(plain)


def test_threshold_covers_every_paragraph(documents):
    # 30 of 2,500 paragraphs hold the words of a template in another order: no notices, but likely ones.
    words = "rights all reserved".split()
    rows = [(i, f"prose of line {i}") for i in range(2470)] + [(3000 + i, " ".join(words) + ".") for i in range(30)]
    described = licences.describe(documents(*rows).select("doc_id", "text"))
    assert described.agg(F.sum("n")).first()[0] == 2500 and described.where("notice").count() == 0
    model, needed, families, keys = licences.train(described)
    assert families[0] == licences.UNKNOWN and model.numFeatures == len(keys)
    assert needed > licences.LEAST_PROBABILITY


def test_described_paragraphs_against_plain_python(documents):
    rng = random.Random(5)
    pool = [t for held in licences.TEMPLATES.values() for t in held]
    texts = []
    for _ in range(300):
        words = rng.choice(pool).split()
        start = rng.randrange(len(words))
        part = words[start:start + rng.randrange(1, 9)] + rng.choices(["the", "of", "plain", "prose", "rights"], k=rng.randrange(4))
        texts.append(" ".join(part))
    rows = [(None if i % 7 == 0 else i % 50, "\n".join(texts[i:i + 3])) for i in range(0, 300, 3)]
    rows += rows[:10]  # repeated rows count twice
    lines = [(i, at, line) for i, text in rows for at, line in enumerate(text.split("\n")) if re.search(r"[^\W\d_]", line)]
    for confirm_at in (0.5, 0.6, 0.9):
        described = licences.describe(documents(*rows).select("doc_id", "text"), confirm_at).collect()
        assert sum(r["n"] for r in described) == len(lines)
        assert sum(r["n"] for r in described if r["notice"]) == sum(nearest(line) >= licences.CONFIRM_AT for _, _, line in lines)
        kept = sorted([(*r["found"],) for r in described if r["found"] for _ in range(r["n"])], key=str)
        assert kept == sorted([line for line in lines if nearest(line[2]) >= confirm_at], key=str)
