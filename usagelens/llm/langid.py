"""Language identification by nearest centroid.

Texts become hashed byte n-gram vectors (2 and 3 bytes of the lower-cased text, other signs than letters as
one blank), damped, weighted by inverse document frequency and normalised. Each language has several
centroids, clustered by cosine; the nearest centroid names the language, and a text farther from all of them
than texts of its length should be is rejected.

Document frequencies count every training text. The centroids are clustered on a bounded sample of labelled
rows: at most `SAMPLE` texts over all languages, shared evenly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import chunks, save

WIDTH = 4096
SAMPLE = 4000
CLUSTERS = 4
REJECT = 0.5
UNDETERMINED = "und"
LETTER = r"\p{L}"

# Bytes that take part: ASCII letters and everything beyond ASCII; the rest counts as a blank.
_KEPT = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts of lower-cased texts, one row each."""
    signs = [np.frombuffer(b"  " + text + b"  ", np.uint8) for text in texts]
    lengths = np.array([len(s) for s in signs])
    b = _KEPT[np.concatenate(signs)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * WIDTH, lengths)
    b = np.append(b, [32, 32]).astype(np.uint32)
    one, two, three = b[:-2], b[1:-1], b[2:]
    # Texts are padded with blanks, so an n-gram over a border of two texts is one of blanks, which is dropped.
    pair, triple = one << 8 | two, one << 16 | two << 8 | three
    total = np.zeros(len(texts) * WIDTH, np.float32)
    for gram, blank in ((pair, 0x2020), (triple, 0x202020)):
        used = gram != blank
        place = (gram[used] * np.uint32(2654435761)) >> np.uint32(20)
        total += np.bincount(owner[used] + place, minlength=len(total)).astype(np.float32)
    return total.reshape(len(texts), WIDTH)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def cluster(rows: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """At most k centroids of unit rows by cosine, started from far-apart rows; the same on every run."""
    picked = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(picked) < min(k, len(rows)):
        nearest = (rows @ rows[picked].T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        picked.append(int(np.argmin(nearest)))
    centroids = rows[picked]
    for _ in range(steps):
        owner = np.argmax(rows @ centroids.T, axis=1)
        centroids = unit(np.stack([rows[owner == c].sum(axis=0) if (owner == c).any() else centroids[c]
                                   for c in range(len(centroids))]))
    return centroids


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray      # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray     # least cosine to accept, by length band

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine to its nearest centroid, and whether that is near enough."""
        raw = counts(texts)
        cosine = unit(np.log1p(raw) * self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return self.owner[best], score, score >= self.floors[band(raw)]


def band(raw: np.ndarray) -> np.ndarray:
    """Length band of a text: the power of two of its n-grams, 20 at most."""
    return np.minimum(np.log2(raw.sum(axis=1) + 1).astype(int), 20)


def train(docs: DataFrame, share_rejected: float = REJECT, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model | None:
    """Learn from `docs(doc_id, text, lang)`; rows without language or letter are left out. None without rows."""
    # No reading of texts for the counts that bound the sample.
    sizes = {row["lang"]: row["count"] for row in
             docs.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(sample // len(sizes), 1)
    share = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x in sizes]),
                                           F.array(*[F.lit(min(1.0, each / n)) for n in sizes.values()])), F.col("lang"))
    steps = 1 << 30
    picked = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(steps)) < share * steps
    usable = (docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
              .select(F.lower("text").cast("binary").alias("text"), "lang", picked.alias("picked")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, seen = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            texts, langs, chosen = (column.to_pylist() for column in batch.columns)
            for start, end in chunks(np.array([len(t) for t in texts]), 2 << 20, 256):
                raw = counts(texts[start:end])
                frequency += (raw > 0).sum(axis=0)
                seen += end - start
                at = [i for i in range(start, end) if chosen[i]]
                if at:
                    vectors = np.log1p(raw[np.array(at) - start]).astype(np.float16)
                    yield rows([-1] * len(at), [0] * len(at), [langs[i] for i in at], [v.tobytes() for v in vectors])
        if seen:
            yield rows(range(WIDTH + 1), [*frequency.tolist(), seen], [None] * (WIDTH + 1), [None] * (WIDTH + 1))

    def rows(place, n, lang, vector) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(n, pa.int64()), pa.array(lang, pa.string()),
                                           pa.array(vector, pa.binary())], ["place", "n", "lang", "vector"])

    scanned = save(usable.mapInArrow(scan, "place int, n long, lang string, vector binary"), "grams")
    frequency = np.zeros(WIDTH + 1)
    for row in scanned.where("place >= 0").groupBy("place").agg(F.sum("n").alias("n")).collect():
        frequency[row["place"]] = row["n"]
    idf = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1).astype(np.float32)
    held: dict[str, list[np.ndarray]] = {}
    for row in scanned.where("place < 0").select("lang", "vector").toLocalIterator():
        held.setdefault(row["lang"], []).append(np.frombuffer(row["vector"], np.float16))
    if not held:
        return None
    languages, owner, centroids, best, bands = sorted(held), [], [], [], []
    for number, language in enumerate(languages):
        damped = np.stack(held[language]).astype(np.float32)
        vectors = unit(damped * idf)
        found = cluster(vectors, clusters)
        centroids.append(found)
        owner += [number] * len(found)
        best.append((vectors @ found.T).max(axis=1))
        bands.append(band(np.expm1(damped)))
    best_all, band_all = np.concatenate(best), np.concatenate(bands)
    floors = np.zeros(21, np.float32)
    for b in range(21):  # a band with few texts has no known distances: nothing is rejected there
        near = best_all[band_all == b]
        floors[b] = share_rejected * np.quantile(near, 0.01) if len(near) >= 20 else 0
    return Model(languages, np.array(owner), np.concatenate(centroids), idf, floors)


def identify(text: Column, model: Model | None) -> Column:
    """Struct(lang, score, rejected) of a text; `und`, 0 and rejected without any letter (or model)."""
    @F.pandas_udf("lang string, score double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = np.full(len(batch), UNDETERMINED, object), np.zeros(len(batch))
            rejected = np.ones(len(batch), bool)
            at = np.flatnonzero(batch.notna().to_numpy()) if model else np.empty(0, int)
            for start, end in chunks(np.array([len(batch.iat[i]) for i in at]), 2 << 20, 256):
                rows = at[start:end]
                number, score, near = model.predict([batch.iat[i] for i in rows])
                langs[rows] = np.array(model.languages, object)[number]
                scores[rows], rejected[rows] = score, ~near
            yield pd.DataFrame({"lang": langs, "score": scores, "rejected": rejected})
    return of(F.when(text.rlike(LETTER), F.lower(text)).cast("binary"))


def languages(docs: DataFrame, training: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score, rejected; learnt from `training` alone.

    Only the text decides. NULL, empty and letterless texts are `und` with score 0 and rejected; repeated
    rows and ties (the first language by name) give equal answers; extra columns are ignored. Without any
    labelled row all is `und`. An empty table gives none.
    """
    found = docs.select("doc_id", identify(F.col("text"), train(training, **options)).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs` whose text is near a known language; learnt from the rows of `docs` with a language."""
    model = train(docs.select("doc_id", "text", "lang"), **options)
    found = docs.select(F.struct("*").alias("_doc"), identify(F.col("text"), model).alias("_found"))
    return found.where(~F.col("_found.rejected")).select("_doc.*")
