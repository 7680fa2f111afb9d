"""Line labels of the quality model are latent: documents are mixed, and shares hold per document."""

import itertools
import zlib

import numpy as np
import pytest

from tests.conftest import SAMPLE
from usagelens.llm import crf
from usagelens.llm.queries import queries

PLAIN = "The river ran past the old mill and the children waited there for their father to come home."
JUNK = "BUY!! NOW!! CHEAP!! WIN!! BIG!! ACT!! FAST!! CALL!! TODAY!! FREE!! DEAL!! HURRY!! LAST!! CHANCE!!"


def _model(spark, documents):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(60):
        plain = [" ".join(rng.permutation(PLAIN.split())) for _ in range(6)]
        junk = [" ".join(rng.permutation(JUNK.split())) for _ in range(4)]
        lines = plain if i % 2 else plain[:2] + junk
        rows.append((i, "\n".join(lines if i % 4 < 2 else lines[::-1])))
        labels.append((i, i % 2))
    return crf.train(documents(*rows), spark.createDataFrame(labels, "doc_id long, quality int"))


def test_a_mixed_document_has_mixed_lines(spark, documents):
    model = _model(spark, documents)
    text = "\n".join([PLAIN] * 3 + [JUNK] * 3)
    docs = documents((1, text), (2, "\n".join([PLAIN] * 6)), (3, "\n".join([JUNK] * 6)), (4, None))
    rows = crf.line_labels(docs, model).collect()
    good = {(r["doc_id"], r["line"]): r["good"] for r in rows}
    assert len(good) == len(rows) == 19
    assert [good[1, i] > 0.5 for i in range(6)] == [True] * 3 + [False] * 3
    assert all(good[2, i] > 0.5 for i in range(6)) and all(good[3, i] < 0.5 for i in range(6)), good
    scores = model.score([t.encode() for t in ("\n".join([JUNK] * 6), text, "\n".join([PLAIN] * 6))])
    assert scores[0] < scores[1] < scores[2] and scores[0] < 0.5 < scores[2]
    assert abs(model.moves[0, 1]) < 20 and model.moves[0, 1] != model.moves[1, 0]


def test_constrained_shares_hold_and_free_documents_stay():
    rng = np.random.default_rng(2)
    lengths, labels = np.array([5, 3, 4, 1]), np.array([1, 0, 1, 0])
    unary, moves, weights = rng.normal(size=(13, 2)), rng.normal(size=(2, 2)), rng.integers(1, 50, 13).astype(float)
    found, _ = crf.constrained(unary, lengths, moves, weights, labels, 0.9, 0.3)
    free = crf.marginals(unary, lengths, moves)[0]
    starts = np.r_[0, np.cumsum(lengths)]
    for d, (a, b) in enumerate(itertools.pairwise(starts)):
        share, was = ((m[a:b, 1] * weights[a:b]).sum() / weights[a:b].sum() for m in (found, free))
        if labels[d]:
            assert share >= 0.9 - 1e-9 and (was >= 0.9 or share < 0.93)
        else:
            assert share <= 0.3 + 1e-9 and (was <= 0.3 or share > 0.27)
        if (was >= 0.9 if labels[d] else was <= 0.3):
            assert np.allclose(found[a:b], free[a:b])


def test_repeated_and_very_long_rows_do_not_swell_the_sample(spark, documents):
    docs = documents(*[(1, PLAIN)] * 50, (2, JUNK), (3, "\n".join([JUNK] * 2000)), (None, JUNK))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    model = crf.train(docs, labels)
    good, bad = model.score([PLAIN.encode(), JUNK.encode()])
    assert good > bad


def test_the_query_against_the_model_by_hand(spark):
    docs, labels = spark.read.parquet(f"{SAMPLE}/documents.parquet"), spark.read.parquet(f"{SAMPLE}/labels.parquet")
    name = next(q for q in queries() if q.startswith("op8_"))
    rows = queries()[name](spark, SAMPLE).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    taught = [r for r in labels.collect() if r["doc_id"] in texts and not held[r["doc_id"]] and r["quality"] in (0, 1)]
    picked = {r["doc_id"]: r["quality"] for r in taught}
    made = sorted((f.tobytes(), w.tobytes(), picked[i]) for i, (f, w) in
                  ((i, crf.document_features(texts[i].encode())) for i in picked) if len(f) <= crf.LINES)
    model = crf.fit([np.frombuffer(f, np.float32).reshape(-1, crf.FEATURES) for f, _, _ in made],
                    [np.frombuffer(w, np.float64) for _, w, _ in made], np.array([q for *_, q in made]))
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == held[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.7)
        assert r["score"] == pytest.approx(model.score([texts[r["doc_id"]].encode()])[0], abs=1e-6)
