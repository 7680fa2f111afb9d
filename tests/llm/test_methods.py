"""The methods themselves, held against exact definitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import components, crf, decontaminate, langid, lbl, merkle, pii, simhash, urlfilter


def groups_of(points, max_bits):
    label = np.arange(len(points))
    close = np.bitwise_count(points[:, None] ^ points[None]) <= max_bits
    while True:
        new = np.where(close, label, len(points)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def clustered_points(n, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(n // 2, n):  # chains and clumps around earlier points
        points[i] = points[rng.integers(0, i)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    return np.unique(points)


@pytest.mark.parametrize("seed", range(3))
def test_tree_in_memory_keeps_every_group(seed, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 16)
    points = clustered_points(1500, seed)
    a, b = simhash.linked_pairs(points, 3)
    assert (np.bitwise_count(points[a] ^ points[b]) <= 64).all() and len(a) < len(points)
    label = np.arange(len(points))
    for _ in range(len(points)):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            break
    assert (label == groups_of(points, 3)).all()


@pytest.mark.parametrize("sample", [0, 3, 400])
def test_routed_shards_hold_every_close_pair(sample):
    points = clustered_points(1200, 9)
    found = set()
    for half in (0, 1):
        router = simhash.Router(points[:sample], half, 1, depth=6)
        for _, held in router.route(points):
            x = points[held]
            i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1))
            found |= {(min(p, q), max(p, q)) for p, q in zip(held[i].tolist(), held[j].tolist())}
        assert sample < 400 or router.shards > 8
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None]) <= 3, 1))
    assert len(i) > 100 and found == set(zip(i.tolist(), j.tolist()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1200)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (7, None), (9000, 9001)], "a long, b long")
    rows = components.components(links).collect()
    label = {row["node"]: row["label"] for row in rows}
    assert len(rows) == len(label) == 301 + 200 + 2
    assert len({label[i] for i in range(301)}) == 1 and len({label[i] for i in range(1000, 1200)}) == 1
    assert len(set(label.values())) == 3
    assert components.components(links.limit(0)).count() == 0


def test_terms_that_disclose_an_entity(documents):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["red", "blue", "green", "walks", "sings", "often", "tree"]) for _ in range(30))
    told = [(i, f"{prose()} Zorblatt wrote from z@example.org {prose()}") for i in range(6)]
    alone = [(10 + i, f"{prose()} {prose()}") for i in range(60)] + [(80, f"{prose()} said Zorblatt, {prose()}")]
    rows = {row["doc_id"]: row for row in pii.find_all(documents(*told, *alone)).collect()}
    names = lambda row, text: [text[s["start"]:s["end"]] for s in row["spans"] if s["kind"] >= pii.TERM]
    texts = dict([*told, *alone])
    assert all("Zorblatt" in names(rows[i], texts[i]) for i in [*range(6), 80])
    assert all(not set(names(rows[i], t)) & {"red", "tree", "often"} for i, t in texts.items())
    clean = {row["doc_id"]: row["text"] for row in pii.sanitise(documents(*told, *alone)).collect()}
    assert "Zorblatt" not in clean[80] and "z@example.org" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[15] == texts[15]


@pytest.mark.parametrize("apart", [0, 12, 500])
def test_a_disclosing_term_may_stand_anywhere_in_the_document(documents, apart):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["red", "blue", "green", "walks", "sings", "often", "tree"]) for _ in range(n))
    told = [(i, f"{prose(9)} Zorblatt {prose(apart)} z@example.org {prose(5)} k9x7") for i in range(8)]
    alone = [(10 + i, prose(60)) for i in range(60)]
    texts = dict([*told, *alone])
    for row in pii.find_all(documents(*told, *alone)).collect():
        marked = {texts[row["doc_id"]][s["start"]:s["end"]] for s in row["spans"] if s["kind"] >= pii.TERM}
        assert marked == ({"Zorblatt", "k9x7"} if row["doc_id"] < 10 else set())


def test_chance_company_of_a_frequent_entity_discloses_nothing(documents):
    rng = random.Random(6)
    rare = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(rare) for _ in range(4)) + (" office@example.org" if i % 3 == 0 else "")) for i in range(400)]
    assert all(len(row["spans"]) == len(row["base"]) for row in pii.find_all(documents(*docs)).collect())


def test_disclosing_terms_equal_plain_counting(documents):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    docs, number = [], 0
    for e in range(12):  # entities with terms that are more or less their own, some told in copies of a text
        for _ in range(rng.randint(2, 7)):
            words = [rng.choice(common) for _ in range(20)] + [f"own{e}", f"half{e // 2}"] + rng.sample([f"r{i}" for i in range(30)], 3)
            rng.shuffle(words)
            text = " ".join([*words, f"user{e}@example.org", *(["25.86.162." + str(e)] if e % 3 == 0 else [])])
            for _ in range(rng.choice([1, 1, 3])):
                docs.append((number, text))
                number += 1
    docs += [(number + i, " ".join(rng.choice([*common, "own1", "own4", "half2"]) for _ in range(15))) for i in range(200)]
    texts = [t for _, t in docs]
    terms = {t: pii.plain_terms(t) for t in set(texts)}
    entities = {t: pii.entities_in(t, pii.base_spans(t)) for t in set(texts)}
    pairs = []
    for e in set().union(*entities.values()):
        docs_e = sum(e in entities[t] for t in texts)
        for w in set().union(*terms.values()):
            different = sum(e in entities[t] and w in terms[t] for t in terms)
            together, docs_w = (sum(w in terms[t] and (e in entities[t] or not both) for t in texts) for both in (True, False))
            with_finds = sum(w in terms[t] and bool(entities[t]) for t in texts)
            if different >= 3 and with_finds <= 2 * together:
                pairs.append((w, different, together, docs_w, docs_e / len(texts)))
    expected = {}
    for w, different, together, docs_w, p in pairs:
        q = together / docs_w
        if q < 0.5 or q <= p:
            continue
        divergence = q * math.log(q / p) + (0 if q == 1 else (1 - q) * math.log((1 - q) / (1 - p)))
        ratio = math.log(q / p) / -math.log(p)
        if different / q * divergence >= math.log(len(pairs) / 0.001) and ratio >= 0.85:
            expected[w] = max(expected.get(w, 0), ratio)
    found = documents(*docs)
    finds = found.select("text", F.xxhash64("text").alias("text_hash"), pii.find_direct(F.col("text")).alias("f")).select("text_hash", "f.*")
    got = {r["term"]: r["kind"] for r in pii.disclosing_terms(found, finds).collect()}
    assert len(expected) > 4 and got == {w: pii.REMOVED if r >= 0.95 else pii.TERM for w, r in expected.items()}


def test_direct_finds_in_odd_places():
    text = "a@b.c@d.e.f x@y 1.2.3.4.5.6.7.8.9 999.1.1.1 x4111 1111-1111 1111 +1 (212) 555-0100) @@q@r.s é@x.yz"
    spans = [(s, pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)]
    assert [x[1:] for x in spans] == [("email", "a@b.c"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111-1111 1111"),
                                      ("phone", "+1 (212) 555-0100"), ("email", "q@r.s")]


def test_language_vectors_know_borders():
    one = langid.counts([b"abc", b"xyz abc", b""])
    assert (one[0] == langid.counts([b"abc"])[0]).all() and (one[1] == langid.counts([b"xyz abc"])[0]).all() and not one[2].any()


def test_substitutions_are_tolerated(spark, documents):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(40)]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    changed = list(item)
    for at in (6, 13, 21, 30, 36):
        changed[at] = "other"
    docs = documents((1, " ".join([*noise(50), *item, *noise(50)])), (2, " ".join([*noise(50), *changed, *noise(50)])),
                     (3, " ".join(noise(200))), (4, " ".join([*noise(20), *item[:14], *noise(20)])), (5, " ".join(item[-13:])))
    rows = {r["doc_id"]: r for r in decontaminate.overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(rows) == {1, 2, 4, 5}
    assert (rows[1]["equal_tokens"], rows[1]["tokens"], rows[1]["first_token"]) == (40, 40, 50)
    assert (rows[2]["equal_tokens"], rows[2]["tokens"]) == (35, 40)


def test_tree_locates_edits():
    text = b"one two three\nfour five\n\nsix seven eight nine ten eleven\nend"
    assert merkle.edits(text, text) == []
    assert merkle.edits(text, text.replace(b"nine", b"NINE")) == [(1, 0)]
    assert str(merkle.Tree(b"a b")) != str(merkle.Tree(b"a  b")) and str(merkle.Tree(b"")) != str(merkle.Tree(b" "))
    joined = b"".join(b"".join(merkle._SPANS.findall(line)) for line in text.splitlines(keepends=True))
    assert joined == text


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    classes = {lbl.END: 0, b"a": 1, b"b": 2}
    size = len(classes) + lbl.RARE
    sequences = [np.r_[rng.integers(1, size, 20), 0].astype(np.int32) for _ in range(50)]
    counts = np.bincount(np.concatenate(sequences), minlength=size).astype(float)
    model = lbl.train(sequences, classes, counts, epochs=1)
    one, two, total = model.tables()
    for u, v in ((0, 1), (size, size), (5, size)):
        assert np.exp(one[u] + two[v] - total[u, v]).sum() == pytest.approx(1, abs=1e-4)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 3])
    unary, moves = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    found, moved, total = crf.marginals(unary, lengths, moves)
    want, want_moves, want_total, start = np.zeros((8, 2)), np.zeros((2, 2)), 0.0, 0
    for n in lengths:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        scores = np.array([sum(unary[start + t, p[t]] for t in range(n)) + sum(moves[p[t - 1], p[t]] for t in range(1, n)) for p in paths])
        weights = np.exp(scores) / np.exp(scores).sum()
        want_total += np.log(np.exp(scores).sum())
        for w, p in zip(weights, paths):
            for t in range(n):
                want[start + t, p[t]] += w
                if t:
                    want_moves[p[t - 1], p[t]] += w
        start += n
    assert np.allclose(found, want) and np.allclose(moved, want_moves) and total == pytest.approx(want_total)


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    listed = spark.range(0, 4000, 7).select(F.xxhash64("id").alias("key"))
    cascade = urlfilter.build_cascade(keys, listed)
    assert len(cascade.levels) > 1
    every = np.array([row["key"] for row in keys.collect()])
    want = {row["key"] for row in listed.collect()}
    assert (cascade.listed(every) == np.array([key in want for key in every.tolist()])).all()
    assert not urlfilter.build_cascade(keys, listed.limit(0)).listed(every).any()


def test_large_test_sets_are_met_alike(spark, documents):
    passage = [f"w{i}" for i in range(20)]
    docs = documents((1, "x " + " ".join(passage) + " y"), (2, " ".join(passage[:9] + ["z"] + passage[10:])), (3, "a q b c"), (3, "a q b c"),
                     (None, "b c"), (4, None), (5, ""), (6, "clean text of several words here"))
    items = spark.createDataFrame([(1, " ".join(passage)), (2, "q"), (3, "b c"), (None, "b c"), (4, "")], "item_id long, text string")
    small = sorted(map(str, decontaminate.overlaps(docs, items).collect()))
    assert small == sorted(map(str, decontaminate.overlaps(docs, items, broadcast_rows=0).collect()))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items).collect()} == {
        (1, 1), (2, 1), (3, 2), (3, 3), (3, None), (None, 3), (None, None)}


def test_terms_are_looked_up_in_runs_of_bounded_size():
    import pyarrow as pa

    class Look:
        def hits(self, terms):
            return {"bb"} & set(terms)

    texts = ["bb " * 200_000, "", "cc " * 200_000, "bb cc"]
    got = list(pii._by_chunk(Look(), pa.array(["x", *texts], pa.string()).slice(1)))
    assert [(first, len(held)) for first, held, _, _ in got] == [(0, 2), (2, 2)]
    assert [text for _, held, _, _ in got for text in held] == texts
    assert [terms for _, _, sets, _ in got for terms in sets] == [{"bb"}, set(), {"cc"}, {"bb", "cc"}]
    assert [wanted for *_, wanted in got] == [{"bb"}, {"bb"}]
