"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text is read as byte ranges. Each range yields a fragment: an open prefix (tokens up to the first byte
offset where tokens of both tokenizers end), the closed groups between two such offsets, and an open
suffix. Fragments form a monoid under `compose`: the suffix of the left one and the prefix of the right
one close one more group. So a long document is cut into chunks that different tasks read, and a tree of
`compose` steps puts it together; a short document is a single chunk.

A chunk owns the tokens that end in its byte range, wherever the range is cut. To tokenise it apart from
its neighbours its context is widened to the nearest safe cuts: before a space or line break after a
visible character both tokenizers start anew (the first one's pattern matches no white space there but a
leading one; no piece of the second one holds a space after another character or a line break, which
is checked on loading). The strings between safe cuts repeat a lot, so each worker keeps the tokens of
recent ones.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import chunks, save

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
CHUNK = 1 << 15
FAN = 8
HOT_PAIRS = 1 << 19
_CACHED_UNITS = 500_000
_BATCH_BYTES = 1 << 19
# Fixed value: how byte-level BPE cuts a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE_END = re.compile(r"[!-~\w]\Z")

Tokens = tuple[list[int], list[int]]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def written(group: Tokens) -> bytes:
    return b"%s|%s" % tuple(",".join(map(str, ids)).encode() for ids in group)


def parsed(text: bytes) -> Tokens:
    a, _, b = text.partition(b"|")
    return [int(x) for x in a.split(b",") if x], [int(x) for x in b.split(b",") if x]


@dataclass
class Fragment:
    """What a byte range says. `cut`: it holds an offset where both end; without one all tokens are in `head`.

    `counts` are tokens of A and B, groups and links of the closed groups in `body`; `pairs` and `times` their
    linked id pairs.
    """

    head: Tokens = field(default_factory=lambda: ([], []))
    tail: Tokens = field(default_factory=lambda: ([], []))
    cut: bool = False
    body: list[bytes] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    whole: bool = True

    def close(self, group: Tokens, size_b: int) -> None:
        """Append a closed group to the body."""
        a, b = group
        if a or b:
            self.body.append(written(group))
            self.counts = self.counts + np.array([len(a), len(b), 1, len(a) * len(b)])
            linked = (np.array(a, np.int64)[:, None] * size_b + np.array(b, np.int64)[None, :]).ravel()
            self.pairs.append(linked)
            self.times.append(np.ones(len(linked), np.int64))

    def append(self, other: Fragment) -> None:
        """Append the body of another fragment."""
        self.body += other.body
        self.counts = self.counts + other.counts
        self.pairs += other.pairs
        self.times += other.times

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the body, in order, and how often each is linked."""
        if not self.pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs, where = np.unique(np.concatenate(self.pairs), return_inverse=True)
        return pairs, np.bincount(where, np.concatenate(self.times), len(pairs)).astype(np.int64)


def compose(left: Fragment, right: Fragment, size_b: int) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with an empty fragment as neutral element."""
    meeting = tuple(x + y for x, y in zip(left.tail if left.cut else left.head, right.head))
    whole = left.whole and right.whole
    if not left.cut:
        return Fragment(meeting, right.tail, right.cut, right.body, right.counts, right.pairs, right.times, whole)
    out = Fragment(left.head, left.tail, True, list(left.body), left.counts, list(left.pairs), list(left.times), whole)
    if not right.cut:
        out.tail = meeting
        return out
    out.close(meeting, size_b)
    out.append(right)
    out.tail = right.tail
    return out


@dataclass
class Closed:
    """All groups of several ranges: their text, with where each range's part ends, and one row per group or link."""

    text: np.ndarray
    text_ends: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    pair_ends: np.ndarray


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, and the tokens of recent strings between safe cuts."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        with open(f"{folder}/{BYTE_LEVEL}", encoding="utf-8") as file:
            described = json.load(file)
        vocabulary = described["model"]["vocab"]
        self.encode_a = _merger(described)
        if self.encode_a is None:
            import tokenizers

            whole = tokenizers.Tokenizer.from_file(f"{folder}/{BYTE_LEVEL}")
            whole.encode_special_tokens = True
            vocabulary = whole.get_vocab(with_added_tokens=True)
            self.encode_a = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        alphabet = byte_alphabet()
        self.size_a, self.size_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.size_a
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.size_b)]
        if any(re.search("[^▁]▁|\n", piece) for piece in pieces):
            raise ValueError(f"{PIECES} has pieces with a space after another character or a line break; texts can't be cut there")
        self.b_bytes = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()
                        for k, piece in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        written_ids = [str(k) for k in range(max(self.size_a, self.size_b))]
        self.width = np.array([len(x) for x in written_ids], np.int64)
        self.digits = np.array([list(x.ljust(len(written_ids[-1])).encode()) for x in written_ids], np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flags = np.zeros((1 << 12, 2), bool)  # bytes differ, no cut after it
        self.ids = [np.zeros(1 << 14, np.int32) for _ in range(2)]
        self.ends = [np.zeros((1 << 12) + 1, np.int64) for _ in range(2)]

    def learn(self, units: set[str]) -> None:
        """Tokenise strings that start with a space or line break and are not known yet."""
        new = [unit for unit in units if unit not in self.known]
        if len(self.known) + len(new) > _CACHED_UNITS:
            self._forget()
            new = list(units)
        if not new:
            return
        # Strings that may be cut after are read in one go, and the tokens dealt to them by their bytes.
        safe = [unit for unit in new if _SAFE_END.search(unit)]
        if not self._add(safe):
            for unit in safe:
                self._add([unit], checked=True)
        for unit in new:
            if not _SAFE_END.search(unit):
                self._add([unit], checked=True)
                self.flags[self.known[unit], 1] = True

    def _add(self, new: list[str], checked: bool = False) -> bool:
        """Add strings to the cache by one call of each tokenizer; False if their bytes differ and there are several."""
        if not new:
            return True
        text = "".join(new)
        raw = text.encode()
        a = self.encode_a(text)
        # The space that is put before a text is its own first one, or one that a line break stays apart from. Nothing
        # is put before an empty text, so a last space by itself is given its piece here.
        b = (self.b.encode(text[1:]) or [self.b.piece_to_id("▁")]) if text[0] == " " else self.b.encode(text)[1:]
        differs = any(b"".join(map(table.__getitem__, ids)) != raw for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        if differs and not checked:
            return False
        first, last = len(self.known), len(self.known) + len(new)
        bounds = np.cumsum([len(unit.encode()) for unit in new])
        self.known.update(zip(new, range(first, last)))
        self.flags = _room(self.flags, last)
        self.flags[first:last, 0] = differs
        for side, found in enumerate((a, b)):
            ids = np.array(found, np.int32)
            upto = np.searchsorted(np.cumsum(self.lengths[side][ids]), bounds) + 1 if len(new) > 1 else len(ids)
            self.ends[side] = _room(self.ends[side], last + 1)
            lo = self.ends[side][first]
            self.ends[side][first + 1:last + 1] = lo + upto
            self.ids[side] = _room(self.ids[side], lo + len(ids))
            self.ids[side][lo:lo + len(ids)] = ids
        return True

    def units(self, context: str) -> tuple[list[str], np.ndarray]:
        """`context`, which starts with a space or line break, cut wherever it is safe; the places of its parts in the cache."""
        lead, *lines = context.split("\n")
        units = [" " + part for part in lead[1:].split(" ")] if lead else []
        for line in lines:
            head, *parts = line.split(" ")
            units.append("\n" + head)
            units += [" " + part for part in parts]
        at = self._places(units)
        apart = ~self.flags[at[:-1], 1]
        if not apart.all():
            starts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(units)]
            units = ["".join(units[lo:hi]) if hi - lo > 1 else units[lo] for lo, hi in zip(starts, starts[1:])]
            at = self._places(units)
        return units, at

    def _places(self, units: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        except KeyError:
            self.learn(set(units))
            return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def tokens(self, side: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends of one tokenizer over known strings in a row."""
        start, size = self.ends[side][at], self.ends[side][at + 1] - self.ends[side][at]
        before = np.cumsum(size) - size
        ids = self.ids[side][np.repeat(start - before, size) + np.arange(size.sum())]
        return ids, np.cumsum(self.lengths[side][ids])

    def close(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray) -> Closed:
        """All groups of ranges that end at the byte offsets `bounds`, where tokens of both end."""
        total = int(bounds[-1]) + 1 if len(bounds) else 1
        is_end = np.zeros((2, total), bool)
        is_end[0, a_ends], is_end[1, b_ends] = True, True
        last_a, last_b = is_end[1, a_ends], is_end[0, b_ends]
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        n_a, n_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # Written: the tokens of A of a group, then those of B; the last of each kind is followed by | or ;
        ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        at_a = np.arange(len(a)) + from_b[of_a]
        at_b = np.arange(len(b)) + (from_a + n_a)[of_b]
        ids[at_a], ids[at_b] = a, b
        sep[at_a[last_a]], sep[at_b[last_b]] = ord("|"), ord(";")
        width = self.width[ids]
        ends = np.cumsum(width + 1)
        text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        text[ends - 1] = sep
        for k in range(self.digits.shape[1]):
            held = width > k
            text[(ends - 1 - width)[held] + k] = self.digits[ids[held], k]
        # Links: every token of A with every token of B of its group.
        times_b = n_b[of_a]
        before = np.cumsum(times_b) - times_b
        linked_b = b[np.repeat(from_b[of_a] - before, times_b) + np.arange(times_b.sum())]
        pair = np.repeat(a.astype(np.int64) * self.size_b, times_b) + linked_b
        range_a, range_b = np.searchsorted(bounds, a_ends), np.searchsorted(bounds, b_ends)
        n = len(bounds)
        group_range = range_a[last_a]
        counts = np.stack([np.bincount(range_a, minlength=n), np.bincount(range_b, minlength=n),
                           np.bincount(group_range, minlength=n), np.bincount(group_range, n_a * n_b, n).astype(np.int64)], 1)
        key = np.sort(np.repeat(range_a, times_b) * (self.size_a * self.size_b) + pair)
        fresh = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[fresh], np.diff(fresh, append=len(key))
        text_ends = np.cumsum(np.bincount(np.concatenate([range_a, range_b]), width[np.concatenate([at_a, at_b])] + 1, n)
                              ).astype(np.int64)
        return Closed(text, text_ends, counts, key % (self.size_a * self.size_b), times,
                      np.cumsum(np.bincount(key // (self.size_a * self.size_b), minlength=n)))

    def stats(self, contexts: list[str]) -> list[tuple]:
        """What `_stats` gives, for whole texts (each with its leading space) that are a chunk of their own."""
        self._make_room(contexts)
        places = [self.units(context)[1] for context in contexts]
        whole = [k for k, at in enumerate(places) if not self.flags[at, 0].any()]
        out: list[tuple] = [_NOTHING] * len(contexts)
        if whole:
            at = np.concatenate([places[k] for k in whole])
            a, a_ends = self.tokens(0, at)
            b, b_ends = self.tokens(1, at)
            sizes = np.array([len(contexts[k].encode()) for k in whole])
            closed = self.close(a, a_ends, b, b_ends, np.cumsum(sizes))
            kind, text, lo, p = _pair_type(self.size_b), memoryview(closed.text), 0, 0
            for k, counts, hi, q in zip(whole, closed.counts.tolist(), closed.text_ends.tolist(), closed.pair_ends.tolist()):
                out[k] = (*counts, hashlib.sha256(text[lo:hi - 1]).hexdigest(), closed.pairs[p:q].astype(kind).tobytes(),
                          closed.times[p:q].astype(np.int32).tobytes())
                lo, p = hi, q
        return out

    def _make_room(self, contexts: list[str]) -> None:
        """Make room first, so that places found for one text still hold when the next one is read."""
        if len(self.known) + sum(map(len, contexts)) // 2 > _CACHED_UNITS:
            self._forget()

    def fragment(self, context: str, before: int = 0, own: int | None = None) -> Fragment:
        """Fragment of the `own` bytes of `context` after the first `before` ones; all of it by default."""
        _, at = self.units(context)
        out = Fragment(whole=not self.flags[at, 0].any())
        if not out.whole:
            return out
        sides = []
        for side in range(2):
            ids, ends = self.tokens(side, at)
            mine = (ends > before) & (ends <= before + own) if own is not None else np.ones(len(ids), bool)
            sides.append((ids[mine], ends[mine]))
        (a, a_ends), (b, b_ends) = sides
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not len(common):
            out.head = a.tolist(), b.tolist()
            return out
        first, last, out.cut = common[0], common[-1], True
        out.head = a[a_ends <= first].tolist(), b[b_ends <= first].tolist()
        out.tail = a[a_ends > last].tolist(), b[b_ends > last].tolist()
        if first < last:
            mid_a, mid_b = (a_ends > first) & (a_ends <= last), (b_ends > first) & (b_ends <= last)
            closed = self.close(a[mid_a], a_ends[mid_a] - first, b[mid_b], b_ends[mid_b] - first, np.array([last - first]))
            out.body, out.counts = [closed.text[:-1].tobytes()], closed.counts[0]
            out.pairs, out.times = [closed.pairs], [closed.times]
        return out


def _merger(described: dict) -> Callable[[str], list[int]] | None:
    """The file's merges, run by the faster library, if the file says no more than that library does.

    Special tokens are not told to it, so their strings are plain text.
    """
    import tiktoken

    model, cutter = described["model"], described["pre_tokenizer"] or {}
    merged = ("".join(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"])
    plain = (cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
             and described["normalizer"] is None and not model.get("dropout") and not model.get("ignore_merges")
             and all(model["vocab"].get(token) == 256 + k for k, token in enumerate(merged)))
    if not plain:
        return None
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): k for token, k in model["vocab"].items()}
    return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """`held`, with space for `size` rows."""
    while len(held) < size:
        held = np.concatenate([held, np.zeros_like(held)])
    return held


_NOTHING = (0, 0, 0, 0, "", b"", b"")


_loaded: dict[str, Tokenizers] = {}


def loaded(folder: str) -> Tokenizers:
    if folder not in _loaded:
        _loaded[folder] = Tokenizers(folder)
    return _loaded[folder]


def ranges(raw: bytes, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """(context from, context to, from, to) of each chunk of a long text; one text between safe cuts gets one edge at most."""
    held = np.frombuffer(raw, np.uint8)
    safe = np.flatnonzero(((held[1:] == 0x20) | (held[1:] == 0x0A)) & (held[:-1] >= 0x21) & (held[:-1] <= 0x7E)) + 1
    safe = np.concatenate([[0], safe, [len(raw)]])
    edges, taken = [0], -1
    for edge in range(chunk, len(raw), chunk):
        cut = int(safe[np.searchsorted(safe, edge, "right") - 1])
        if cut != taken:
            edges.append(edge)
            taken = cut
    edges.append(len(raw))
    for lo, hi in zip(edges, edges[1:]):
        yield int(safe[np.searchsorted(safe, lo, "right") - 1]), int(safe[np.searchsorted(safe, hi, "left")]), lo, hi


_FRAGMENT = ("row long, k int, head binary, tail binary, cut boolean, body binary, counts array<long>, pairs binary, "
             "times binary, whole boolean")
_STATS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_STATS_ARROW = pa.schema([(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
                         + [("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def _stats(fragment: Fragment, size_b: int) -> tuple:
    """The finished document: its prefix is closed by the start of the text, its suffix is empty."""
    if not fragment.whole:
        return _NOTHING
    out = Fragment(cut=True)
    out.close(fragment.head, size_b)
    out.append(fragment)
    out.close(fragment.tail, size_b)
    pairs, times = out.links()
    return (*map(int, out.counts), hashlib.sha256(b";".join(out.body)).hexdigest(),
            pairs.astype(_pair_type(size_b)).tobytes(), times.astype(np.int32).tobytes())


def _pair_type(size_b: int) -> type:
    return np.int32 if size_b <= 1 << 15 else np.int64


def _columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(values, kind) for values, kind in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)]


def _pack(fragment: Fragment) -> dict:
    pairs, times = fragment.links()
    return {"head": written(fragment.head), "tail": written(fragment.tail), "cut": fragment.cut,
            "body": b";".join(fragment.body), "counts": fragment.counts.tolist(), "pairs": pairs.tobytes(),
            "times": times.tobytes(), "whole": fragment.whole}


def _unpack(row: dict) -> Fragment:
    return Fragment(parsed(row["head"]), parsed(row["tail"]), row["cut"], [row["body"]] if row["body"] else [],
                    np.array(row["counts"], np.int64), [np.frombuffer(row["pairs"], np.int64)],
                    [np.frombuffer(row["times"], np.int64)], row["whole"])


def aligned(docs: DataFrame, folder: str = TOKENIZERS, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, token, group and link counts, the digest of its groups, its links.

    `pairs` and `times` hold the distinct linked pairs (id of A times size of B plus id of B) and how often
    each occurs. NULL, empty and not wholly representable texts get zeros, '' and no links.
    """
    rows = docs.select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    kind = dict(rows.dtypes)["doc_id"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(folder)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(sizes, _BATCH_BYTES, 1 << 10):
                part = texts.slice(lo, hi - lo).to_pylist()
                scored = iter(own.stats([" " + x for x in part if x]))
                found = [next(scored) if x else _NOTHING for x in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *_columns(found, _STATS_ARROW)],
                                                 ["doc_id", *_STATS_ARROW.names])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = (" " + batch.column(2)[k].as_py()).encode()
                cuts = list(ranges(raw, chunk))
                n = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * n, batch.schema.types[0]),
                     pa.array([batch.column(1)[k].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array([n] * n, pa.int32()), pa.array([raw[lo:hi].decode() for lo, hi, _, _ in cuts], pa.string()),
                     pa.array([start - lo for lo, _, start, _ in cuts], pa.int32()),
                     pa.array([end - start for _, _, start, end in cuts], pa.int32())],
                    ["doc_id", "row", "k", "parts", "context", "before", "own"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(folder)
        for batch in batches:
            for row in batch.to_pylist():
                packed = _pack(own.fragment(row["context"], row["before"], row["own"]))
                yield pa.RecordBatch.from_pylist([{"row": row["row"], "k": row["k"]} | packed], _arrow_fragment())

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        size_b, out = loaded(folder).size_b, Fragment()
        for row in table.sort_by("k").to_pylist():
            out = compose(out, _unpack(row), size_b)
        return pa.Table.from_pylist([{"row": key[0].as_py(), "k": key[1].as_py()} | _pack(out)], _arrow_fragment())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_b = loaded(folder).size_b
        for batch in batches:
            found = [_stats(_unpack(row), size_b) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *_columns(found, _STATS_ARROW)],
                                             ["row", *_STATS_ARROW.names])

    few = rows.where(size <= chunk).mapInArrow(short, f"doc_id {kind}, {_STATS}")
    # Chunks of long documents are dealt out before they are tokenised.
    cut = save(rows.where(size > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
               .mapInArrow(split, f"doc_id {kind}, row long, k int, parts int, context string, before int, own int")
               .repartition("row", "k"), "chunks")
    state = save(cut.select("row", "k", "context", "before", "own").mapInArrow(read, _FRAGMENT), "fragments")
    most = cut.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        names = [name for name in state.columns if name not in ("row", "k")]
        state = save(state.select("row", F.expr(f"k div {fan}").cast("int").alias("parent"), "k", *names)
                     .groupBy("row", "parent").applyInArrow(reduce, _FRAGMENT), "fragments")
        most = -(-most // fan)
    long_rows = cut.where(F.col("k") == 0).select("row", "doc_id").join(state.mapInArrow(finish, f"row long, {_STATS}"), "row")
    return few.unionByName(long_rows.drop("row"))


def _arrow_fragment() -> pa.Schema:
    return pa.schema([("row", pa.int64()), ("k", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()),
                      ("cut", pa.bool_()), ("body", pa.binary()), ("counts", pa.list_(pa.int64())),
                      ("pairs", pa.binary()), ("times", pa.binary()), ("whole", pa.bool_())])


def pair_counts(links: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no pair of its A id has more."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_b, pairs, times = loaded(folder).size_b, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for lo, hi in chunks(np.full(batch.num_rows, 1), 1 << 30, 1 << 10):
                raw = b"".join(x.as_py() or b"" for x in batch.column(0).slice(lo, hi - lo))
                seen, n = np.unique(np.frombuffer(raw, _pair_type(size_b)), return_counts=True)
                merged, where = np.unique(np.concatenate([pairs, seen.astype(np.int64)]), return_inverse=True)
                pairs, times = merged, np.bincount(where, np.concatenate([times, n]), len(merged)).astype(np.int64)
                if len(pairs) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])
                    pairs, times = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

    size_b = loaded(folder).size_b
    counts = save(links.select("pairs").mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                  .withColumn("a", F.expr(f"pair div {size_b}")), "pairs")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, folder: str = TOKENIZERS, chunk: int = CHUNK, fan: int = FAN,
          hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: what `aligned` counts, n_best and count_sum.

    The most frequent pairs, at most `hot_pairs` (16 bytes each), travel to the tasks; documents meet the
    counts of all others in a join, so the bound changes the way and not the result. NULL, empty and not
    wholly representable texts count zeros. Repeated rows are documents of their own; rows without doc_id take
    part like any other; extra columns are ignored; an empty table gives none.
    """
    found = save(aligned(docs, folder, chunk, fan), "aligned")
    counts = save(pair_counts(found, folder), "pair_counts")
    level = F.floor(F.log2("n")).cast("int")
    room, least = hot_pairs, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 64 rows at most
        room -= row["count"]
        if room < 0:
            least = 2 ** (row["level"] + 1)
            break
    hot = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    table = docs.sparkSession.sparkContext.broadcast(tuple(
        hot.column(name).to_numpy() for name in ("pair", "n", "best")))
    kind, size_b = dict(found.dtypes)["doc_id"], loaded(folder).size_b

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            sums, rest = [], []
            for raw, often in zip(batch.column("pairs"), batch.column("times")):
                held = np.frombuffer(raw.as_py(), _pair_type(size_b)).astype(np.int64)
                times = np.frombuffer(often.as_py(), np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(pair, held), max(len(pair) - 1, 0))
                hit = pair[at] == held if len(pair) else np.zeros(len(held), bool)
                sums.append((int(times[hit][best[at[hit]]].sum()), int((times[hit] * n[at[hit]]).sum())))
                rest.append([{"pair": int(p), "times": int(t)} for p, t in zip(held[~hit], times[~hit])])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(7)], pa.array([x for x, _ in sums], pa.int64()),
                 pa.array([x for _, x in sums], pa.int64()),
                 pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))],
                ["row", "doc_id", *_STATS_ARROW.names[:5], "n_best", "count_sum", "rest"])

    stats = ", ".join(_STATS.split(", ")[:5])
    scored = save(found.select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(
        look_up, f"row long, doc_id {kind}, {stats}, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"),
        "scored")
    rest = (scored.select("row", F.inline("rest")).join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                 F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
