"""NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns; one case per operator."""

import pytest

import corpus_pipeline
from usagelens.llm import crf, decontaminate, langid, lbl, licences, merkle, mixing, pii, simhash, urlfilter


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, " ".join(f"w{i}" for i in range(30)))],
                                 "item_id long, text string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, 1), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")


def by_text(rows, *names):
    return sorted(tuple(row[n] for n in names) for row in rows)


def test_simhash(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    empty = [row for row in rows if row["fp"] == 0]
    assert len(empty) == 4 and {row["component_id"] for row in empty} == {1}
    same = [row for row in rows if row["doc_id"] == 5]
    assert len(same) == 2 and {row["component_id"] for row in same} == {5}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(row["doc_id"] or 0 for row in kept.collect()) == [0, 0, 1, 4, 5, 5, 6]
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_personal_data(awkward):
    rows = pii.find_all(awkward).collect()
    assert len(rows) == awkward.count() and all(row["spans"] == [] for row in rows)
    assert pii.find_all(awkward.limit(0)).count() == 0
    clean = pii.sanitise(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()


def test_language(awkward):
    rows = langid.languages(awkward, awkward).collect()
    assert len(rows) == awkward.count()
    assert sum(row["lang_pred"] == "und" and row["score"] == 0 and row["rejected"] for row in rows) == 4
    assert {row["lang_pred"] for row in rows} == {"und", "de", "en"}
    assert {row["lang_pred"] for row in langid.languages(awkward, awkward.where("lang is null")).collect()} == {"und"}
    assert langid.languages(awkward.limit(0), awkward.limit(0)).count() == 0


def test_mix(awkward):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(row["taken"] <= 2 * row["size"] and row["target"] <= 2 * row["source_size"] for row in rows)
    assert all(row["taken"] == 0 for row in rows if row["size"] == 0)
    repeated = [row for row in rows if row["doc_id"] == 5]
    assert len(repeated) == 2 and repeated[0] == repeated[1]
    made = mixing.repeat_documents(awkward)
    assert made.columns == [*awkward.columns, "mix_repetition", "mix_words"]
    assert all(len(row["text"].split()) == row["mix_words"] for row in made.collect())
    assert mixing.mix(awkward.limit(0)).count() == 0 and mixing.mix(awkward.where("text is null")).count() == 2


def test_decontamination(awkward, benchmark):
    found = decontaminate.overlaps(awkward, benchmark).collect()
    assert [(row["doc_id"], row["item_id"], row["first_token"], row["equal_tokens"]) for row in found] == [(6, 1, 0, 3)]
    kept = decontaminate.keep_clean(awkward, benchmark)
    assert kept.columns == awkward.columns
    assert sorted(row["doc_id"] or 0 for row in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 5]
    assert decontaminate.overlaps(awkward, benchmark.limit(0)).count() == 0
    assert decontaminate.overlaps(awkward.limit(0), benchmark).count() == 0


def test_fingerprints(awkward):
    rows = merkle.fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    empty = {row["fingerprint"] for row in rows if row["n_chars"] == 0}
    assert len(empty) == 1 and all(row["near_edited"] == 1 for row in rows if row["n_chars"] == 0)
    single = merkle.fingerprints(awkward.where("doc_id = 6")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1
    assert merkle.fingerprints(awkward.limit(0)).count() == 0


def test_language_model(awkward):
    from pyspark.sql import functions as F
    rows = lbl.score(awkward, F.coalesce(F.col("doc_id") != 6, F.lit(False)), positions=2000).collect()
    assert len(rows) == awkward.count()
    assert all(row["n_tokens"] == 1 for row in rows if row["doc_id"] in (1, 2, 3)) and all(row["score"] < 0 for row in rows)
    assert lbl.score(awkward.limit(0), F.lit(True)).count() == 0
    untaught = lbl.score(awkward, F.lit(False)).collect()
    assert {(row["train_tokens"], row["base_score"]) for row in untaught} == {(0, 0.0)}


def test_quality(awkward, labels):
    rows = crf.score(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= row["score"] <= 1 for row in rows)
    assert len({row["score"] for row in rows if row["doc_id"] in (1, 2)}) == 1
    assert {row["score"] for row in crf.score(awkward, labels.limit(0)).collect()} == {0.5}
    assert crf.score(awkward.limit(0), labels).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "net/", "x"), (4, "http://NET", "x"), (5, "http://a.NET/x?y#z", "x"),
                                   (5, "http://a.NET/x?y#z", "x"), (None, "https://www.example.net/en/?a=http://b.org/fr/", "x"),
                                   (6, "x://https://b.org/fr/", "x"), (7, "http://example.network/en/", "x"),
                                   (8, "http://" + "a." * 300 + "net/" + "p" * 10_000, "x")], "page_id long, url string, host string")
    got = {row["page_id"]: row for row in urlfilter.judge(pages).collect()}
    assert [got[i]["rule"] for i in (1, 2, 3, 4, 6, 7)] == [None] * 6
    assert (got[5]["host"], got[5]["path"], got[5]["rule"], got[5]["verdict"]) == ("a.net", "/x", "net/", "block")
    assert (got[None]["rule"], got[None]["verdict"]) == ("example.net/en/", "allow")
    assert (got[6]["host"], got[6]["path"]) == ("https:", "//b.org/fr/") and got[8]["rule"] == "net/"
    assert urlfilter.judge(pages).count() == 10 and urlfilter.judge(pages.limit(0)).count() == 0
    assert {row["verdict"] for row in urlfilter.judge(pages, rules=(), default="block").collect()} == {"block"}


def test_licences(documents):
    docs = documents((1, None), (2, ""), (3, "All rights reserved.\nplain words here"), (3, "All rights reserved.\nplain words here"),
                     (None, "x\nReleased under the MIT License."), (4, "the rights of all were reserved for others in the long text " * 30))
    found = licences.scan(docs).collect()
    assert by_text([r for r in found if r["doc_id"]], "doc_id", "paragraph", "family") == [(3, 0, "reserved")] * 2
    assert [(r["paragraph"], r["family"]) for r in found if r["doc_id"] is None] == [(1, "mit")]
    assert licences.scan(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, awkward, tmp_path):
    spark.createDataFrame([(1, "nothing in common with any of these at all")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for docs in (awkward, awkward.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns[:len(awkward.columns)] == awkward.columns
        docs.count()


def test_columns_with_the_names_of_internal_ones(spark, benchmark):
    """Filtering stages pass on extra columns, whatever they are called."""
    names = ["_gone", "_hit", "_doc", "_labelled", "fp", "component_id", "label", "rep", "token", "held", "s", "a.b"]
    docs = spark.createDataFrame([(1, "one two three", *names), (2, "one two three", *names), (3, "all other words here", *names)],
                                 "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(row[0] for row in kept.collect()) == [1, 3]
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and [row[0] for row in kept.collect()] == [3]


def test_text_ids_have_an_order(spark):
    docs = spark.createDataFrame([("a", "one text"), ("b", "two texts"), ("c", "three")], "doc_id string, text string")
    rows = {row["doc_id"]: row for row in merkle.fingerprints(docs).collect()}
    assert rows.keys() == {"a", "b", "c"} and rows["b"]["n_chars"] == 9
    numbered = spark.createDataFrame([(1, "one text"), (2, "two texts"), (3, "three")], "doc_id long, text string")
    by_number = {row["doc_id"]: tuple(row)[1:] for row in merkle.fingerprints(numbered).collect()}
    assert {"abc".index(key) + 1: tuple(row)[1:] for key, row in rows.items()} == by_number


def test_language_model_learns_from_every_training_text(spark, documents, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F
    docs = documents(*[(i, "a b c") for i in range(400)], (400, "b a"), (401, "b a"), (401, "b a"), (None, "b a"))
    parts, average = [], lbl._averaged
    monkeypatch.setattr(lbl, "_averaged", lambda rows, state: parts.append(rows.agg(F.sum("tokens")).first()[0]) or average(rows, state))
    rows = lbl.score(docs, F.coalesce(F.col("doc_id") != 0, F.lit(True)), positions=100).collect()  # far more tokens than `positions`
    assert sum(parts) == rows[0]["train_tokens"] == 399 * 4 + 4 * 3 and len(parts) == lbl.ROUNDS
    known = {row["doc_id"]: row["score"] for row in rows}
    assert np.isfinite(known[0]) and known[0] > known[400]


def test_language_model_learns_alike_from_large_and_small_tables(spark, documents, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F
    docs = documents(*[(i, "a b c") for i in range(60)], (60, None))
    asked, train_on_all = [], lbl.train_on_all
    monkeypatch.setattr(lbl, "train_on_all", lambda *args: asked.append((args[0].where("turn is not null").count(), *args[3:])) or train_on_all(*args))
    for positions in (100, 100_000):
        lbl.score(docs, F.col("doc_id") != 0, positions=positions).collect()
    assert [(rows, epochs * passes) for rows, _, epochs, passes in asked] == [(60, lbl.EPOCHS)] * 2

    size, sequences = 3 + lbl.RARE, [np.array([1, 2, 0], np.int16), np.array([2, 2, 1, 0], np.int16)]
    counts = np.bincount(np.concatenate(sequences), minlength=size).astype(float)
    coded = spark.createDataFrame([(0, bytearray(w.tobytes()), 9) for w in sequences], "turn int, kinds binary, size long").coalesce(1)
    got = train_on_all(coded, {lbl.END: 0, b"a": 1, b"b": 2}, counts, 1, 1, 3)
    state, rng = lbl.start(counts), np.random.default_rng((0, 0))
    for _ in range(3):
        lbl.learn(state, np.concatenate(sequences), np.array([0, 3]), lbl.noise_share(counts), rng)
    assert np.allclose(got.bias, state[2]) and np.allclose(got.target, state[1])
