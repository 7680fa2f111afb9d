"""Personal data: direct finds, and terms that disclose them by corpus co-occurrence.

Direct finds (`base_spans`) are e-mail and IP addresses, card and phone numbers. Other terms of a document may give the same
entity away after it has been blanked out. How strongly term t reveals entity e is measured over whole documents of the
whole corpus: PMI(t; e) = log(P(e | t) / P(e)), against the information of the entity itself, IC(e) = -log P(e). PMI / IC is 1
when t occurs with e alone and 0 when they are independent. A term with a ratio of `generalise_at` or more, for some entity, is
generalised wherever it occurs, from `remove_at` on removed. Terms must accompany the entity in `min_texts` different
texts and in half of their own documents, and chance must be unlikely to bring so much company about: n texts of which a share q
hold an entity of probability p come by chance with at most exp(-n KL(q, p)), which has to be below `chance` over the number of
pairs judged. Without that, words of three texts would "disclose" an address that stands in a third of the corpus.

The corpus is read three times: finds and the terms beside them, document counts of the candidate terms, places of
the disclosing terms. The last two look terms up in a Bloom filter of fixed size and are put right by a join. Pairs of entity and
term are formed only for entities and terms of `min_texts` texts with finds, and where the term is not already met too often in
those texts: a term that stands with e in half of its documents has at most twice the documents of e.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.joins import spread_join
from usagelens.llm.common import chunks, save

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)       # a term to generalise
REMOVED = TERM + 1      # a term to remove
_NAMES = (*KINDS, "term", "term")
_MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")

MIN_TEXTS = 3
GENERALISE_AT = 0.85
REMOVE_AT = 0.95
CHANCE = 0.001
_FILTER_BITS = 20

# The patterns of the four kinds; an address is put together in `_emails` and `_addresses`.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W_]{2,}")

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> Iterator[Span]:
    """Matches around each @; the local part reaches back to the last match at most. Linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, 0, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[Span]:
    """Groups of four out of each chain of dotted numbers."""
    for chain in _DIGIT_CHAIN.finditer(text):
        parts = chain[0].split(".")
        start = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + len(".".join(four))
            if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in four):
                yield start, 1, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All direct finds as (start, kind, end) in code points, by start, then kind."""
    spans = list(_emails(text))
    spans += _addresses(text)
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = _NO_DIGIT.sub("", match[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((match.start(), 2, match.end()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", match[0])) <= 15:
            spans.append((match.start(), 3, match.end()))
    return sorted(spans)


def terms_in(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _without(text: str, spans: list[Span]) -> str:
    """The text with its finds blanked out, lengths kept."""
    out, done = [], 0
    for start, _, end in spans:  # by start; finds of different kinds may overlap
        if end > done:
            out += [text[done:start], " " * (end - max(start, done))]
            done = end
    return "".join([*out, text[done:]])


def entities_in(text: str, spans: list[Span]) -> set[tuple[int, str]]:
    """(kind, value) of all finds, written alike."""
    return {(kind, text[start:end].lower() if kind < 2 else _NO_DIGIT.sub("", text[start:end])) for start, kind, end in spans}


def plain_terms(text: str) -> set[str]:
    """The terms outside direct finds."""
    spans = base_spans(text)
    return set(terms_in(_without(text, spans) if spans else text))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _span_array(rows: list[list[Span]]) -> list[list[dict]]:
    return [[{"start": s, "kind": k, "end": e} for s, k, e in spans] for spans in rows]


def find_direct(text: Column) -> Column:
    """Struct(spans, entities, terms) of a text; NULL counts as empty. Terms, each once, only of texts with finds."""
    @F.pandas_udf(f"spans {_SPANS}, entities array<struct<kind:int,value:string>>, terms array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [base_spans(value) for value in batch]
            yield pd.DataFrame({
                "spans": _span_array(spans),
                "entities": [[{"kind": k, "value": v} for k, v in sorted(entities_in(value, held))] for value, held in zip(batch, spans)],
                "terms": [sorted(set(terms_in(_without(value, held)))) if held else [] for value, held in zip(batch, spans)]})
    return of(F.coalesce(text, F.lit("")))


class TermFilter:
    """A Bloom filter over terms, of fixed size: more terms only mean more false hits for the join."""

    def __init__(self, terms: DataFrame):
        mask, h = F.lit((1 << _FILTER_BITS) - 1), F.xxhash64("term")
        places = terms.select(F.explode(F.array(*[F.shiftrightunsigned(h, 20 * i).bitwiseAND(mask) for i in range(3)])).alias("bit"))
        words = (places.groupBy(F.shiftright("bit", 5).alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).collect())
        self.words = np.zeros(1 << (_FILTER_BITS - 5), np.uint32)
        for row in words:
            self.words[row["word"]] = row["bits"]
        self.empty = not words

    def hits(self, terms: list[str]) -> set[str]:
        """The terms that may be in the filter."""
        if not terms:
            return set()
        h = np.array([xxhash.xxh64_intdigest(term, 42) for term in terms], np.uint64)
        inside = np.ones(len(h), bool)
        for i in range(3):
            bit = (h >> np.uint64(20 * i)) & np.uint64((1 << _FILTER_BITS) - 1)
            inside &= (self.words[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return {terms[i] for i in np.flatnonzero(inside)}


def _by_chunk(look: TermFilter, column: pa.Array) -> Iterator[tuple[int, list[str], list[set[str]], set[str]]]:
    """(first row, texts, term sets, terms that pass the filter) for bounded runs of texts, whatever a batch holds."""
    for start, end in chunks(np.asarray(pc.binary_length(column)), 1 << 20, 4096):
        texts = column.slice(start, end - start).to_pylist()
        sets = [set(terms_in(text)) for text in texts]
        yield start, texts, sets, look.hits(list(set().union(*sets)))


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents) for the given terms outside direct finds, over all texts; some other terms may come along."""
    look = TermFilter(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for _, texts, sets, wanted in _by_chunk(look, batch.column(0)):
                for text, held in zip(texts, sets):
                    if held & wanted:
                        total.update(plain_terms(text) & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                             ["term", "n"])

    return (docs.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("documents")))


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term, start, end) of all places of the given terms outside direct finds."""
    look = TermFilter(terms)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (column.to_pylist() for column in batch.columns[:2])
            found: list[tuple] = []
            for first, texts, sets, wanted in _by_chunk(look, batch.column(2)):
                for i, (text, held) in enumerate(zip(texts, sets), first):
                    if held & wanted:
                        plain = _without(text, base_spans(text))
                        found += [(ids[i], hashes[i], m[0].lower(), m.start(), m.end())
                                  for m in _TERM.finditer(plain) if m[0].lower() in wanted]
            columns = list(zip(*found)) if found else [[]] * 5
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["doc_id", "text_hash", "term", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    located = (docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
               .mapInArrow(places, f"doc_id {kind}, text_hash long, term string, start int, end int"))
    return located.join(terms, "term").select("doc_id", "text_hash", "start", "end", "kind")


def company(finds: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(entity_kind, value, entity_documents, term, texts, together) of entities and terms that may belong together.

    `texts` are different ones, `together` and `entity_documents` count their copies too. Pairs that can't reach `min_texts` or
    half of the term's documents are left out, most of them before they are formed.
    """
    texts = save(finds.where(F.size("entities") > 0).groupBy("text_hash").agg(
        F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "texts")
    said = texts.select("text_hash", "copies", F.explode("entities").alias("e")).select(
        "text_hash", "copies", F.col("e.kind").alias("entity_kind"), F.col("e.value").alias("value"))

    def repeated(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.count("*").alias("texts"), F.sum("copies").alias("documents")).where(F.col("texts") >= min_texts)

    entities = repeated(said, "entity_kind", "value").select("entity_kind", "value", F.col("documents").alias("entity_documents"))
    held = save(spread_join(said, entities, ["entity_kind", "value"], ["text_hash"]), "entities")
    words = texts.select("text_hash", "copies", F.explode("terms").alias("term"))
    often = save(repeated(words, "term").select("term", F.col("documents").alias("least_documents")), "words")
    rarest = held.groupBy("text_hash").agg(F.max("entity_documents").alias("most"))
    near = spread_join(words.join(rarest, "text_hash"), often, ["term"], ["text_hash"]).where(
        F.col("least_documents") <= 2 * F.col("most")).select("text_hash", "term", "least_documents")
    met = held.join(near, "text_hash").where(F.col("least_documents") <= 2 * F.col("entity_documents"))
    pairs = met.groupBy("entity_kind", "value", "entity_documents", "term", "least_documents").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("together"))
    return pairs.where((F.col("texts") >= min_texts) & (F.col("least_documents") <= 2 * F.col("together"))).drop("least_documents")


def disclosing_terms(docs: DataFrame, finds: DataFrame, min_texts: int = MIN_TEXTS, generalise_at: float = GENERALISE_AT,
                     remove_at: float = REMOVE_AT, chance: float = CHANCE) -> DataFrame:
    """`finds(text_hash, entities, terms)` over `docs` to (term, kind): what discloses an entity, and how it is treated."""
    candidates = save(company(finds, min_texts), "candidates")
    judged = candidates.count()
    if not judged:
        return docs.sparkSession.createDataFrame([], "term string, kind int")
    counts = document_counts(docs, candidates.select("term").distinct())
    total = F.lit(docs.count())
    given_term = F.col("together") / F.col("documents")
    entity = F.col("entity_documents") / total
    ratio = F.try_divide(F.log(given_term / entity), -F.log(entity))

    def part(share: Column, base: Column) -> Column:
        return F.when(share > 0, share * F.log(share / base)).otherwise(0.0)

    # Texts, not their copies, are evidence.
    evidence = F.col("texts") / given_term * (part(given_term, entity) + part(1 - given_term, 1 - entity))
    known = (candidates.join(counts, "term").where((given_term >= 0.5) & (given_term > entity) & (entity < 1))
             .where(evidence >= F.log(F.lit(judged / chance))))
    best = known.groupBy("term").agg(F.max(ratio).alias("ratio")).where(F.col("ratio") >= generalise_at)
    return save(best.select("term", F.when(F.col("ratio") >= remove_at, REMOVED).otherwise(TERM).alias("kind")), "terms")


def find_all(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, text_hash, base and spans (arrays of start, kind, end).

    NULL and empty texts have no spans; equal texts have equal spans; rows without doc_id are treated
    like others; extra columns are ignored; an empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    finds = save(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), find_direct(F.col("text")).alias("f"))
                 .select("doc_id", "text_hash", F.col("f.spans").alias("base"), "f.entities", "f.terms"), "finds")
    terms = disclosing_terms(docs, finds, **options)
    if terms.isEmpty():
        return finds.select("doc_id", "text_hash", "base", F.col("base").alias("spans"))
    more = (term_places(docs, terms).distinct().groupBy("doc_id", "text_hash")
            .agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
            .select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "more"))
    both = finds.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    return both.select("doc_id", "text_hash", "base",
                       F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(name) for name in _NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sanitised(text: str, spans: list) -> str:
    """The text with each run of overlapping spans replaced by the mark of its first span."""
    out, done = [], 0
    for span in spans:
        start, kind, end = span["start"], span["kind"], span["end"]
        if start >= done:
            out += [text[done:start], _MARKS[kind]]
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """`docs` with personal data in `text` replaced by marks; `n_chars`, where there is one, follows the text.

    All rows and columns stay, also those without doc_id. NULL stays NULL, empty texts and texts without finds stay as they are;
    equal texts are treated alike; an empty table gives none.
    """
    found = (find_all(docs, **options).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").distinct().alias("s"))
    rows = docs.select(F.struct("*").alias("_doc"), F.xxhash64("text").alias("_hash")).alias("d")
    joined = rows.join(found, F.col("_doc.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("_hash") == F.col("s.text_hash")), "left")

    @F.pandas_udf("string")
    def replace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([text if held is None or text is None else sanitised(text, held) for text, held in zip(texts, spans)],
                            dtype=object)

    made = joined.select("_doc", replace(F.col("_doc.text"), F.col("spans")).alias("_text"))
    out = {name: F.col(f"_doc.`{name}`") for name in docs.columns}
    out["text"] = F.col("_text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_doc.text") != F.col("_text"), F.length("_text").cast("long")).otherwise(F.col("_doc.n_chars"))
    return made.select(*[column.alias(name) for name, column in out.items()])
