"""Operators against plain Python over the small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.conftest import SAMPLE
from usagelens.llm import queries as register

SPACE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def texts(spark):
    return {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}


def result(spark, name):
    return {row["doc_id"]: row for row in register.queries()[name](spark, SAMPLE).collect()}


def ascii_words(text):
    return [w for w in re.split(f"[{SPACE}]+", text) if w]


def test_simhash_groups(spark, texts):
    def fingerprint(text):
        words = ascii_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = result(spark, "op1_simhash_vptree")
    want = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: int(row["fingerprint"], 16) for i, row in got.items()} == want
    assert all(len(row["fingerprint"]) == 16 for row in got.values())
    group = {i: i for i in want}
    changed = True
    while changed:
        changed = False
        for a in want:
            least = min(group[b] for b in want if (want[a] ^ want[b]).bit_count() <= 3)
            if least < group[a]:
                group[a], changed = least, True
    assert {i: row["component_id"] for i, row in got.items()} == group


def test_personal_data_equals_plain_patterns(spark, texts):
    def passes(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            odd = sum(int(d) for d in digits[-1::-2])
            even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
            return 12 <= len(digits) <= 19 and (odd + even) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    got = result(spark, "op2_pii_sanitise")
    found_any = 0
    for i, text in texts.items():
        spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(patterns.items())
                       for m in re.finditer(p, text) if passes(kind, m[0]))
        found_any += bool(spans)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()
        assert set(s for *_, s in spans) <= set(got[i]["spans"].split(",")) | {""}
        for k, kind in enumerate(patterns):
            assert got[i][f"n_{kind}"] == sum(1 for s in spans if s[1] == k)
    assert found_any > 5


def test_held_out_languages(spark, texts):
    truth = {row["doc_id"]: row["lang"] for row in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    got = result(spark, "op3_language_centroid")
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(i for i, row in got.items() if row["held_out"]) == sorted(held)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= row["score"] <= 1 for row in got.values())
    assert sum(row["rejected"] for i, row in got.items() if re.search(r"[^\W\d_]", texts[i])) <= 2


def test_mix_meets_targets(spark, texts):
    rows = list(result(spark, "op4_mix_waterfill").values())
    source = {row["doc_id"]: row["source"] for row in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    size = {i: len(ascii_words(t)) for i, t in texts.items()}
    assert {row["doc_id"]: row["size"] for row in rows} == size
    totals, taken = {}, {}
    for row in rows:
        totals[source[row["doc_id"]]] = totals.get(source[row["doc_id"]], 0) + row["size"]
        taken[source[row["doc_id"]]] = taken.get(source[row["doc_id"]], 0) + row["taken"]
        assert row["taken"] <= 2 * row["size"]
    # Resharing step by step, as the rule says it.
    names, left, target = sorted(totals), 1.5 * sum(totals.values()), {}
    weight = {name: (5, 2, 1)[k % 3] for k, name in enumerate(names)}
    while True:
        open_names = [n for n in names if n not in target]
        shares = {n: left * weight[n] / sum(weight[m] for m in open_names) for n in open_names}
        capped = [n for n in open_names if shares[n] > 2 * totals[n]]
        if not capped:
            target |= shares
            break
        for name in capped:
            target[name] = 2.0 * totals[name]
            left -= target[name]
    for row in rows:
        assert row["target"] == pytest.approx(target[source[row["doc_id"]]])
        assert row["source_size"] == totals[source[row["doc_id"]]]
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)


def test_decontamination_finds_every_contained_item(spark, texts):
    items = {row["item_id"]: row["text"] for row in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()}
    words = lambda t: " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w)
    plain = {k: f" {words(t)} " for k, t in texts.items()}
    want = {(d, i) for i, item in items.items() for d, text in plain.items() if f" {words(item)} " in text}
    got = register.queries()["op5_spaced_seed_decontamination"](spark, SAMPLE).collect()
    assert want and {(row["doc_id"], row["item_id"]) for row in got if row["item_share"] == 1} == want
    for row in got:
        start = row["first_token"]
        assert words(items[row["item_id"]]).split()[:1] and row["equal_tokens"] >= 0.8 * row["tokens"]
        assert len(plain[row["doc_id"]].split()) >= start + row["tokens"]


def test_merkle_walk(spark, texts):
    got = result(spark, "op6_merkle_fingerprint")
    order = sorted(texts, reverse=True)
    for here, after in zip(order, [*order[1:], order[0]]):
        n = len(texts[here]) // 3
        changed = texts[here][:len(texts[here]) - n] + texts[after][:n]
        row = got[here]
        assert row["n_chars"] == len(texts[here])
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (changed == texts[here])
        assert (row["near_next"] == 1) == (texts[here] == texts[after]) or row["near_next"] < 1
    assert len({row["fingerprint"] for row in got.values()}) == len(set(texts.values()))
    assert np.mean([row["near_edited"] for row in got.values()]) > 0.5


def _branches(fingerprint):
    """{(section, paragraph): digests} of a returned string."""
    return {(i, j): paragraph for i, section in enumerate(fingerprint.split(":")[1].split(";"))
            for j, paragraph in enumerate(section.split(","))}


def test_merkle_likeness_and_branches_follow_from_the_returned_strings(spark, texts):
    got = result(spark, "op6_merkle_fingerprint")

    def digests(fingerprint):
        held = re.sub("[,;]", "", fingerprint.split(":")[1])
        return Counter(held[i:i + 8] for i in range(0, len(held), 8))

    def share(a, b):
        one, other = digests(a), digests(b)
        return 2 * (one & other).total() / (one.total() + other.total()) if one or other else 1.0

    order = sorted(texts, reverse=True)
    for here, after in zip(order, [*order[1:], order[0]]):
        row = got[here]
        assert row["near_edited"] == share(row["fingerprint"], row["edited_fingerprint"])
        assert row["near_next"] == share(row["fingerprint"], got[after]["fingerprint"])
        one, other = _branches(row["fingerprint"]), _branches(row["edited_fingerprint"])
        changed = sorted(at for at in one.keys() | other.keys() if one.get(at) != other.get(at))
        assert row["n_branches"] == len(changed)
        assert row["first_branch"] == (f"{changed[0][0]}.{changed[0][1]}" if changed else None)


def test_language_model_counts_and_base_score(spark, texts):
    got = result(spark, "op7_lbl_score")

    def tokens(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        return [*ascii_words(lowered), None]  # None: the end

    rows = [(row["doc_id"], row["text"] or "") for row in spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").collect()]
    counts = Counter(t for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    total, distinct = counts.total(), len(counts)
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        own = tokens(text)
        row = got[i]
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), total)
        assert row["base_score"] == pytest.approx(sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in own), rel=1e-9)
        assert row["score"] < 0
