"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its label depends on features of the line itself, of the lines before and after it, and on
the neighbouring labels. A document's raw score is the mean probability of its lines being good (forward-backward
marginals), weighted by line length; a logistic curve fitted on the training documents turns it into the probability of label 1.

Labels are known of documents only, those of lines are latent. They are learnt by EM with a constraint per document: at
least `GOOD_SHARE` of the length of a document of label 1 is good, at most `BAD_SHARE` of one of label 0. The
expectation step takes the line labels nearest to the model's that meet it, which adds one multiple of the line's length to
the score of the good label. So a plain line in a bad document stays good.

The model is fitted on the driver on at most `SAMPLE` labelled documents of at most `LINES` lines, half of each label as
far as there are; scoring goes over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import chunks, save

SAMPLE = 4000
LINES = 500
GOOD_SHARE, BAD_SHARE = 0.95, 0.5
ROUNDS, STEPS = 6, 30
GOOD_FROM = 0.7
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_PLAIN = _LETTERS + _DIGITS + b" \t\n\r\x0b\x0c.,;:'\"()-?"
OWN = 11


def line_features(line: bytes) -> tuple[float, ...]:
    """Shares of kinds of signs, repetition and shape of one line."""
    size, words = len(line), line.split()
    if not words:
        return (1.0, *[0.0] * (OWN - 1))
    letters = size - len(line.translate(None, _LETTERS))
    upper = size - len(line.translate(None, _UPPER))
    repeated = sum(map(eq, words, words[1:]))
    return (0.0, min(np.log1p(size) / 10, 1.0), upper / max(letters, 1), (size - len(line.translate(None, _DIGITS))) / size,
            len(line.translate(None, _PLAIN)) / size, float(line.count(b"|") * 20 > size), min(line.count(b"!") / len(words), 1.0),
            repeated / len(words), len(set(words)) / len(words), letters / size, min(size / len(words) / 20, 1.0))


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines, with those of both neighbours and a constant, and line weights."""
    lines = text.split(b"\n")
    seen: dict[bytes, tuple] = {}
    own = np.array([seen[line] if line in seen else seen.setdefault(line, line_features(line)) for line in lines], np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(lines), 3), np.float32)
    edge[:, 0], edge[0, 1], edge[-1, 2] = 1, 1, 1
    return np.hstack([own, before, after, edge]), np.array([max(len(line), 1) for line in lines], np.float64)


FEATURES = 3 * OWN + 3


@dataclass
class Model:
    weights: np.ndarray     # feature by label
    moves: np.ndarray       # label to label
    slope: float
    offset: float

    def raw(self, features: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean marginal of the good label, per document."""
        lengths = np.array([len(f) for f in features])
        good = marginals(np.concatenate(features) @ self.weights, lengths, self.moves)[0][:, 1]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        w = np.concatenate(weights)
        return np.add.reduceat(good * w, starts) / np.add.reduceat(w, starts)

    def score(self, texts: list[bytes]) -> np.ndarray:
        made = [document_features(text) for text in texts]
        return squash(self.slope * logit(self.raw([f for f, _ in made], [w for _, w in made])) + self.offset)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def marginals(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once: label marginals, expected moves, log of all sums.

    Chains are sorted by length, so step t works on those that are longer than t.
    """
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    unary = unary.astype(np.float64)
    ahead, back = unary.copy(), np.zeros_like(unary)
    longest = int(size[0])
    open_at = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # chains longer than t
    for t in range(1, longest):
        now = first[:open_at[t]] + t
        for s in (0, 1):
            ahead[now, s] += _log_sum(ahead[now - 1] + moves[:, s])
    for t in range(longest - 1, 0, -1):
        now = first[:open_at[t]] + t
        for s in (0, 1):
            back[now - 1, s] = _log_sum(unary[now] + back[now] + moves[s])
    total = np.empty(len(lengths))
    total[order] = _log_sum(ahead[first + size - 1])
    per_row = np.repeat(total, lengths)
    inner = np.ones(len(unary), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    joint = ahead[at - 1][:, :, None] + moves[None] + (unary[at] + back[at])[:, None, :] - per_row[at][:, None, None]
    return np.exp(ahead + back - per_row[:, None]), np.exp(joint).sum(axis=0), float(total.sum())


def _own_labels(x: np.ndarray, y: np.ndarray, steps: int = 100, decay: float = 1e-3) -> np.ndarray:
    """Probability of the good label from a line's own features alone, learnt from copied document labels: where EM begins."""
    own = np.hstack([x[:, :OWN], np.ones((len(x), 1))])
    w = np.zeros(own.shape[1])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _ascend(w, own.T @ (y - squash(own @ w)) / len(y) - decay * w, mean, square, step)
    return squash(own @ w)


def _ascend(p: np.ndarray, g: np.ndarray, mean: np.ndarray, square: np.ndarray, step: int) -> None:
    """One Adam step along the gradient, in place."""
    mean += 0.1 * (g - mean)
    square += 0.01 * (g * g - square)
    p += 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)


def constrained(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray, weights: np.ndarray, labels: np.ndarray,
                good_share: float = GOOD_SHARE, bad_share: float = BAD_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Line marginals and expected moves nearest to the model's under which every document has its share of good length.

    The share grows with the multiple of the line lengths added to the good label, so the least one is found by bisection.
    """
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    total = np.add.reduceat(weights, starts)
    pull = weights * np.repeat(lengths / total, lengths)  # 1 for a line of the document's mean length
    sign = np.where(labels == 1, 1.0, -1.0)

    def at(multiple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tilted = unary.astype(np.float64)
        tilted[:, 1] += np.repeat(sign * multiple, lengths) * pull
        found, moved, _ = marginals(tilted, lengths, moves)
        share = np.add.reduceat(found[:, 1] * weights, starts) / total
        return found, moved, np.where(labels == 1, share >= good_share, share <= bad_share)

    low, high = np.zeros(len(lengths)), np.full(len(lengths), 64.0)
    found, moved, met = at(low)
    if met.all():
        return found, moved
    high[met] = 0.0
    for _ in range(12):
        middle = (low + high) / 2
        met = at(middle)[2]
        low, high = np.where(met, low, middle), np.where(met, middle, high)
    return at(high)[:2]


def fit(features: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS,
        decay: float = 1e-3) -> Model:
    """EM over latent line labels under the documents' constraints, Adam steps in between, then the logistic curve."""
    x, lengths = np.concatenate(features), np.array([len(f) for f in features])
    size = np.concatenate(weights)
    model = Model(np.zeros((x.shape[1], 2)), np.zeros((2, 2)), 1.0, 0.0)
    parameters = [model.weights, model.moves]
    mean, square = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    begin = _own_labels(x, np.repeat(labels, lengths))
    unary = np.stack([np.zeros(len(x)), logit(begin)], axis=1)
    for turn in range(rounds):
        wanted, wanted_moves = constrained(unary, lengths, model.moves, size, labels)
        for step in range(turn * steps + 1, (turn + 1) * steps + 1):
            found, moved, _ = marginals(x @ model.weights, lengths, model.moves)
            gradients = [x.T @ (wanted - found) / len(x) - decay * model.weights,
                         (wanted_moves - moved) / len(x) - decay * model.moves]
            for p, g, m, s in zip(parameters, gradients, mean, square):
                _ascend(p, g, m, s, step)
        unary = x @ model.weights
    raw = logit(model.raw(features, weights))
    slope, offset = 1.0, 0.0
    for _ in range(30):  # Newton steps on two parameters, slightly held back
        p = squash(slope * raw + offset)
        g = np.array([((labels - p) * raw).sum() - 0.1 * (slope - 1), (labels - p).sum() - 0.1 * offset])
        v = p * (1 - p)
        h = np.array([[(v * raw * raw).sum() + 0.1, (v * raw).sum()], [(v * raw).sum(), v.sum() + 0.1]])
        change = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = max(slope + change[0], 0.05), offset + change[1]
    model.slope, model.offset = float(slope), float(offset)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Model | None:
    """Learn from `labels(doc_id, quality)` on `docs(doc_id, text)`; None without a labelled document.

    Of several rows of a document the least text is learnt from; texts of more than `lines` lines are not learnt from.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {row["quality"]: row["count"] for row in usable.groupBy("quality").count().collect()}
    picked = None
    for quality in sizes:  # 0 and 1
        part = usable.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample // 2)
        picked = part if picked is None else picked.unionAll(part)
    if picked is None:
        return None
    chosen = F.broadcast(save(picked, "labelled").withColumnRenamed("doc_id", "_labelled"))  # at most `sample` rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, quality in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                features, weights = document_features(text)
                yield pa.RecordBatch.from_arrays([pa.array([features.tobytes()]), pa.array([weights.tobytes()]), pa.array([quality], pa.int32())],
                                                 ["features", "weights", "quality"])

    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < lines)
            .join(chosen, F.col("doc_id") == F.col("_labelled"))
            .groupBy("_labelled").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
            .select(F.col("text").cast("binary"), F.col("quality").cast("int"))
            .mapInArrow(describe, "features binary, weights binary, quality int"))
    # In a fixed order, so that runs agree to the last digit of a sum.
    held = sorted((row["features"], row["weights"], row["quality"]) for row in rows.toLocalIterator())
    if not held:
        return None
    features = [np.frombuffer(f, np.float32).reshape(-1, FEATURES) for f, _, _ in held]
    return fit(features, [np.frombuffer(w, np.float64) for _, w, _ in held], np.array([q for *_, q in held]))


def quality(text: Column, model: Model | None) -> Column:
    """Probability of label 1; 0.5 without a model."""
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            scores = np.full(len(batch), 0.5)
            for start, end in chunks(np.array([len(text) for text in batch]), 2 << 20, 1000) if model else ():
                scores[start:end] = model.score(list(batch.iloc[start:end]))
            yield pd.Series(scores)
    return of(F.coalesce(text, F.lit("")).cast("binary"))


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, good): every line of the texts, counted from 0, with its probability of being good.

    NULL and empty texts are one empty line; repeated rows repeat their lines.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(1).to_pylist()):
                features, _ = document_features(text)
                good = marginals(features @ model.weights, np.array([len(features)]), model.moves)[0][:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).slice(at, 1).to_pylist() * len(good), batch.column(0).type),
                                                  pa.array(np.arange(len(good)), pa.int64()), pa.array(good)], ["doc_id", "line", "good"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .mapInArrow(of, f"doc_id {kind}, line long, good double"))


def score(docs: DataFrame, labels: DataFrame, good_from: float = GOOD_FROM, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, score, predicted. Only the text decides.

    NULL and empty texts count as one empty line; equal texts score alike; labels without a document, other labels
    than 0 and 1 and NULLs are left out; of several labels of a document the least counts, of several texts the least
    is learnt from; extra columns are ignored; an empty table gives none.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), **options)
    scored = docs.select("doc_id", quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= good_from).cast("int"))
