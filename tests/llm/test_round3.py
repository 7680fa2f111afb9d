"""Alignment, spelling variants and the Jaccard join against plain Python, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers

from tests.conftest import SAMPLE
from usagelens.llm import align, jaccard, variants
from usagelens.llm import queries as register


@pytest.fixture(scope="module")
def texts(spark):
    return {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- alignment


def whole_alignment(texts):
    """Groups from both tokenizers run over whole texts."""
    a = tokenizers.Tokenizer.from_file(f"{align.TOKENIZERS}/{align.BYTE_LEVEL}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{align.TOKENIZERS}/{align.PIECES}")
    alphabet = align.byte_alphabet()
    out = {}
    for key, text in texts.items():
        if not text:
            out[key] = []
            continue
        full = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(alphabet[c] for c in a.id_to_token(x)) for x in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode()
                 for x in ids_b for p in [b.id_to_piece(x)]]
        if b"".join(raw_a) != full or b"".join(raw_b) != full:
            out[key] = []
            continue
        ends = []
        for raw in (raw_a, raw_b):
            at, held = 0, []
            for piece in raw:
                at += len(piece)
                held.append(at)
            ends.append(held)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], 0
        for hi in common:
            groups.append(([x for x, e in zip(ids_a, ends[0]) if lo < e <= hi], [x for x, e in zip(ids_b, ends[1]) if lo < e <= hi]))
            lo = hi
        out[key] = groups
    return out


def alignment_rows(texts):
    groups = whole_alignment(texts)
    links = {key: [(x, y) for ga, gb in value for x in ga for y in gb] for key, value in groups.items()}
    count = Counter(pair for value in links.values() for pair in set(value))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for key, value in groups.items():
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in value)
        out.append((key, sum(len(ga) for ga, _ in value), sum(len(gb) for _, gb in value), len(value), len(links[key]),
                    sum(count[p] == highest[p[0]] for p in links[key]), sum(count[p] for p in links[key]),
                    hashlib.sha256(text.encode()).hexdigest() if value else ""))
    return sorted(out, key=repr)


ODD = {1: None, 2: "", 3: " ", 4: "  two  spaces \n\n tabs\t\tend ", 5: "a▁b", 6: "<|endoftext|> <s> <0x0A> \x00 </s>",
       7: "naïve café 東京へ行く \U0001F600\U0001F600  nbsp 　 x", 8: "don't can't I'll 12345 67 8.9 --- ...", 9: "x" * 300,
       10: "東京" * 200, 11: "a b" * 150, 12: "a\x1c b\u0085 c  d"}


def test_alignment_of_whole_tables(spark, texts):
    assert rows_of(register.queries()["op11_fragment_alignment"](spark, SAMPLE)) == alignment_rows(texts)


@pytest.mark.parametrize("chunk, hot", [(7, 0), (64, 3), (1 << 15, 1 << 19)])
def test_alignment_by_chunks(spark, documents, texts, chunk, hot):
    some = dict(ODD) | {100 + i: texts[i][:1500] for i in range(0, 60, 7)}
    got = align.align(documents(*some.items()), chunk=chunk, fan=2, hot_pairs=hot)
    assert rows_of(got) == alignment_rows(some)


def test_fragments_are_associative(texts):
    own = align.loaded(align.TOKENIZERS)
    raw = (" " + texts[3][:3000] + ODD[7]).encode()
    parts = [own.fragment(raw[lo:hi].decode(), start - lo, end - start) for lo, hi, start, end in align.ranges(raw, 11)]
    want = align._stats(own.fragment(raw.decode()), own.size_b)
    rng = random.Random(5)
    for _ in range(5):
        left = list(parts)
        while len(left) > 1:
            k = rng.randrange(len(left) - 1)
            left[k:k + 2] = [align.compose(left[k], left[k + 1], own.size_b)]
        assert align._stats(left[0], own.size_b) == want
    nothing = align.Fragment()
    assert align._stats(align.compose(nothing, align.compose(left[0], nothing, own.size_b), own.size_b), own.size_b) == want


def test_alignment_edges(spark, awkward):
    rows = align.align(awkward, chunk=4096).collect()
    assert len(rows) == awkward.count()
    assert sum(row["n_a"] == 0 and row["groups_sha256"] == "" for row in rows) == 3  # two NULLs and one empty text
    same = [tuple(row)[1:] for row in rows if row["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1] and same[0][3] > 0
    assert align.align(awkward.limit(0)).count() == 0


# --- spelling variants


def one_edit(w, v):
    if len(w) == len(v):
        return sum(x != y for x, y in zip(w, v)) == 1
    if len(w) > len(v):
        w, v = v, w
    return len(v) == len(w) + 1 and any(v[:k] + v[k + 1:] == w for k in range(len(v)))


def variant_rows(texts, least_length=7, least_count=2, times=10, every=31):
    n = Counter()
    for key, text in texts.items():
        run = ""
        for c in (text or "") + "\0":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                if len(run) >= least_length:
                    n[run] += 1
            run = ""
    n = {w: k for w, k in n.items() if k >= least_count}
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length[size] if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def test_variants_of_whole_tables(spark, texts):
    assert rows_of(register.queries()["op12_trie_variants"](spark, SAMPLE)) == variant_rows(texts)


def test_variants_of_invented_words(spark, documents):
    rng = random.Random(11)
    some = {}
    for i in range(60):
        held = []
        for _ in range(40):
            word = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))
            held += [word] * rng.choice((1, 1, 2, 12))
        some[i] = " ".join(held).upper() + " ŁódźŁ x×y"
    got = variants.group_variants(documents(*some.items()), least_length=1, least_count=1, times=2, error_every=5)
    want = variant_rows(some, 1, 1, 2, 5)
    assert any(form and form != root for _, form, root, *_ in want)  # chains of forms occur
    assert rows_of(got) == want


def test_variant_edges(spark, awkward, documents):
    found = {row["word"] for row in variants.group_variants(awkward, 3, error_every=1 << 40).collect()}
    assert found == {"wörd", "und"}
    assert variants.group_variants(awkward.limit(0)).count() == 0
    assert variants.group_variants(documents((1, None), (2, ""), (None, "1 2 3"))).count() == 0
    # A tie of n goes to the first word; rows without doc_id count.
    tied = documents((None, "colours " * 10), (1, "coloura " * 10), (2, "colourx"), (2, "colourx"))
    got = {row["word"]: row["form"] for row in variants.group_variants(tied, times=2, error_every=1 << 40).collect()}
    assert got == {"colours": None, "coloura": None, "colourx": "coloura"}


# --- Jaccard join


def shingles(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set()


def jaccard_rows(rows, percent=90):
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k, held in enumerate(sets):
        for token in held:
            holders[token].append(k)
    for pair in {(x, y) for held in holders.values() for x in held for y in held if x < y}:
        x, y = pair
        both = len(sets[x] & sets[y])
        if 100 * both >= percent * len(sets[x] | sets[y]):
            parent[top(x)] = top(y)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(k)] = min(least.get(top(k), doc_id), doc_id)
    return sorted(((doc_id, len(sets[k]), least.get(top(k))) for k, (doc_id, _) in enumerate(rows)), key=repr)


def test_jaccard_of_whole_tables(spark, texts):
    assert rows_of(register.queries()["op13_jaccard_orders"](spark, SAMPLE)) == jaccard_rows(list(texts.items()))


@pytest.mark.parametrize("orders, block", [(1, 1024), (3, 2)])
def test_jaccard_of_near_copies(spark, documents, orders, block):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(150):  # one large group of copies with few to many edits, chains included
        words = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 9))):
            words[rng.randrange(len(words))] = f"e{rng.randrange(6)}"
        rows.append((i, " ".join(words[:rng.choice((90, 90, 88, 84))])))
    rows += [(200 + i, f"common line here {i}") for i in range(40)] + [(300 + i, "A b") for i in range(3)] + [(310, "a"), (311, "a b c")]
    rng.shuffle(rows)
    got = jaccard.jaccard_groups(documents(*rows), orders=orders, block=block)
    assert rows_of(got) == jaccard_rows(rows)


def test_jaccard_edges(spark, awkward):
    rows = [(row["doc_id"], row["text"]) for row in awkward.collect()]
    assert rows_of(jaccard.jaccard_groups(awkward)) == [row for row in jaccard_rows(rows)]
    assert jaccard.jaccard_groups(awkward.limit(0)).count() == 0


def test_prefix_filter_loses_nothing():
    """Sets at the threshold share a prefix token under every order, whatever the frequency levels say."""
    import numpy as np
    rng = np.random.default_rng(2)
    levels = rng.integers(0, 9, 1 << 20).astype(np.uint8)
    for n in (1, 5, 19, 40, 190, 377):
        for lost in range(n // 10 + 1):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[lost:], rng.integers(0, 1 << 63, lost, dtype=np.uint64)]) if n % 2 else x[lost:]
            shared = len(np.intersect1d(x, y))
            if 100 * shared < 90 * len(np.union1d(x, y)):
                continue
            sides = [jaccard.prefixes_of(np.unique(s), levels, 90, 3) for s in (x, y)]
            assert all(len(np.intersect1d(a, b)) for a, b in zip(*sides))


def test_jaccard_parities_reject_far_pairs_and_no_near_one(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        x, y = np.unique(pool[:rng.integers(1, 300)]), np.unique(pool[rng.integers(0, 100):rng.integers(100, 400)])
        differ = int(np.bitwise_count((jaccard.parities(x) ^ jaccard.parities(y)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(x, y))
    sets = [np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))]
    sets += [np.unique(np.r_[sets[0][:300 - k], rng.integers(0, 1 << 63, k).astype(np.uint64)]) for k in (10, 100)]
    prefixes = spark.createDataFrame([(i, len(s), jaccard.parities(s).tolist()) for i, s in enumerate(sets)], "rep long, n long, odd array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    assert [tuple(r) for r in jaccard._close(pairs, prefixes, 90).collect()] == [(0, 1)]
