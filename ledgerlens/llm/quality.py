"""Quality classifier from weak labels.

1. Heuristic labellers vote on every text: 1 (good), 0 (bad) or -1 (abstain).  They
   overlap and disagree; each covers the whole text.
2. Label model: expectation-maximisation over the vote patterns estimates the class
   share and, per labeller and class, how often it votes good, bad or not at all.  The
   patterns of all documents are counted by one aggregate; only the table of patterns
   (at most 3^labellers rows) reaches the driver.
3. A hashed linear scorer is trained on the posterior labels of a bounded sample (the
   ``max_rows`` smallest hashes of doc_id): word, word ending and word shape features,
   hashed to 2^BITS weights and averaged over the text, logistic loss on soft labels.
4. Every text is scored by the scorer alone, in one pass without a shuffle.

Cases: null or empty texts have no words: most labellers abstain, ``too_short`` votes
bad, the score is the scorer's bias.  Null doc_id: voted and scored, never sampled.
Repeated rows get equal results.  No documents: no rows (the model is empty, score 0.5).
Only doc_id and text are read; other columns pass through ``score`` and columns named
like the results (votes, posterior, score) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.textarrays import _BYTE, Sequences, Words, lowered, mix64, parts, utf8

BITS = 18


@dataclass(frozen=True)
class Labeller:
    """Votes bad beyond ``bad``, good within ``good``, and abstains between them."""
    name: str
    bad: float
    good: float

    def votes(self, value: np.ndarray) -> np.ndarray:
        up = self.bad >= self.good
        bad = value >= self.bad if up else value <= self.bad
        good = value <= self.good if up else value >= self.good
        return np.where(np.isnan(value), -1, np.where(bad, 0, np.where(good, 1, -1))).astype(np.int8)


LABELLERS = (
    Labeller("upper_share", bad=0.5, good=0.15),        # ASCII capitals among ASCII letters
    Labeller("symbol_share", bad=0.08, good=0.015),     # ASCII characters that are neither word, space, stop nor comma
    Labeller("distinct_share", bad=0.25, good=0.6),     # distinct words among words
    Labeller("top_word_share", bad=0.25, good=0.12),    # the most frequent word
    Labeller("stops_share", bad=0.01, good=0.04),       # words that end in . , ; or :
    Labeller("odd_end_share", bad=0.3, good=0.05),      # words that end in another symbol
    Labeller("twin_share", bad=0.1, good=0.03),         # words equal to the one before
    Labeller("too_short", bad=2.5, good=12.0),          # number of words
)

_CLASS = np.zeros(256, dtype=np.uint8)                  # 0 space, 1 lower, 2 upper, 3 digit, 4 stop, 5 symbol, 6 above ASCII
_CLASS[33:127] = 5
_CLASS[[ord(c) for c in ".,;:"]] = 4
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:256] = 3, 2, 1, 6


def _per_text(words: Words, value: np.ndarray) -> np.ndarray:
    return np.bincount(words.row, weights=value, minlength=len(words.first) - 1)


def measures(words: Words, raw: np.ndarray) -> np.ndarray:
    """(labellers, texts): the measure behind each labeller; NaN where there is nothing to measure."""
    n_texts = len(words.first) - 1
    n = np.diff(words.first).astype(float)
    kind = _CLASS[raw]
    chars = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.at])
    lower, upper, symbol, written = chars(kind == 1), chars(kind == 2), chars(kind == 5), chars(kind > 0)
    h = words.hashes()
    # a word of one text: its hash shifted by a multiple of the text's number
    place, count = np.unique(mix64(h + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True,
                             return_counts=True)[1:]
    row = words.row[place]
    distinct, top = np.bincount(row, minlength=n_texts).astype(float), np.zeros(n_texts)
    np.maximum.at(top, row, count)
    last = kind[words.end - 1] if len(h) else np.zeros(0, dtype=np.uint8)
    twin = np.zeros(len(h))
    if len(h) > 1:
        twin[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.stack([upper / np.where(lower + upper >= 20, lower + upper, np.nan),
                         symbol / np.where(written >= 20, written, np.nan),
                         # repetition grows with length whatever the quality; 200 words are the yardstick
                         distinct / np.where(n >= 20, np.minimum(n, 200.0), np.nan),
                         top / np.where(n >= 20, n, np.nan),
                         _per_text(words, last == 4) / np.where(n >= 20, n, np.nan),
                         _per_text(words, last == 5) / np.where(n >= 20, n, np.nan),
                         _per_text(words, twin) / np.where(n >= 20, n, np.nan),
                         n])


def votes_of(words: Words, raw: np.ndarray) -> np.ndarray:
    """(texts, labellers) of 1, 0 and -1."""
    return np.stack([lab.votes(v) for lab, v in zip(LABELLERS, measures(words, raw))], axis=1)


# ---------------------------------------------------------------- label model

@dataclass
class LabelModel:
    share: float                     # of good
    says: np.ndarray                 # (2 classes, labellers, 3 votes: abstain, bad, good); abstaining is no evidence: 1

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(np.stack([np.full(len(votes), 1 - self.share), np.full(len(votes), self.share)]))
        for j in range(votes.shape[1]):
            log += np.log(self.says[:, j, votes[:, j] + 1])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))

    def accuracies(self) -> np.ndarray:
        """Per labeller: the chance that a vote it gives is right."""
        return (1 - self.share) * self.says[0, :, 1] + self.share * self.says[1, :, 2]


def expectation_maximisation(patterns: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
    """From distinct vote patterns and their counts.  Begins with the majority of the votes given,
    a single bad vote weighing as much as three good ones: labellers look for faults."""
    k = patterns.shape[1]
    good, bad = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    q = np.where(good + bad > 0, (good + 0.5) / (good + 3.0 * bad + 1.0), 0.5)
    model = LabelModel(0.5, np.full((2, k, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([(1 - q) * count, q * count])
        total = weight.sum(axis=1)
        share = (total[1] + 1) / (total.sum() + 2)
        says = np.ones((2, k, 3))
        for c in (0, 1):
            given = np.stack([(weight[c][:, None] * (patterns == v)).sum(axis=0) + 1 for v in (0, 1)], axis=1)
            says[c, :, 1:] = given / given.sum(axis=1, keepdims=True)
        model = LabelModel(float(share), says)
        now = model.posterior(patterns)
        if np.abs(now - q).max() < 1e-7:
            break
        q = now
    return model


# ---------------------------------------------------------------- scorer

def scorer_features(words: Words, raw: np.ndarray) -> np.ndarray:
    """(features, words): indexes of word, ending and shape; the shape has the classes of the first,
    second and last byte, whether the word repeats the one before, and its length class."""
    if not len(words):
        return np.zeros((3, 0), dtype=np.int64)
    mask = np.uint64((1 << BITS) - 1)
    low = lowered(raw)
    h = Sequences(_BYTE[low]).spans(words.start, words.end)
    tail = Sequences(_BYTE[low]).spans(np.maximum(words.start, words.end - 2), words.end)
    kind = _CLASS[raw].astype(np.uint64)
    second = kind[np.minimum(words.start + 1, words.end - 1)]
    twin = np.zeros(len(h), dtype=np.uint64)
    twin[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    length = np.minimum(words.end - words.start, 15).astype(np.uint64) // np.uint64(3)
    shape = (((kind[words.start] * np.uint64(8) + second) * np.uint64(8) + kind[words.end - 1]) * np.uint64(2) + twin) \
        * np.uint64(8) + length
    return np.stack([h & mask, (tail ^ np.uint64(0x5BD1E995)) & mask,
                     (shape * np.uint64(0x9E3779B1) + np.uint64(77)) & mask]).astype(np.int64)


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, words: Words, raw: np.ndarray) -> np.ndarray:
        n = len(words.first) - 1
        sums = np.zeros(n)
        for f in scorer_features(words, raw):
            sums += np.bincount(words.row, weights=self.weights[f], minlength=n)
        return 1 / (1 + np.exp(-np.clip(sums / np.maximum(np.diff(words.first), 1) + self.bias, -35, 35)))


def train_scorer(texts: list[str | None], labels: LabelModel, rounds: int = 60, rate: float = 0.5) -> Model:
    model = Model(labels, np.zeros(1 << BITS), 0.0)
    if not texts:
        return model
    targets, values, rows, means, n = [], [], [], [], 0
    for part in parts(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])):
        data, at = utf8(part.column("text"))
        words = Words(data, at)
        targets.append(labels.posterior(votes_of(words, data)))
        size = np.maximum(np.diff(words.first), 1)
        for f in scorer_features(words, data):       # a feature of one text once, with its weight in the text's mean
            cell, count = np.unique(f * part.num_rows + words.row, return_counts=True)
            values.append(cell // part.num_rows)
            rows.append(cell % part.num_rows + n)
            means.append(count / size[cell % part.num_rows])
        n += part.num_rows
    target, value, text, mean = map(np.concatenate, (targets, values, rows, means))
    # both classes count alike, or the rarer one would be ignored
    weight = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    squares, square_b = np.full(1 << BITS, 1e-10), 1e-10
    for _ in range(rounds):
        z = np.bincount(text, weights=model.weights[value] * mean, minlength=len(texts)) + model.bias
        gap = (target - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) * weight
        grad = np.bincount(value, weights=gap[text] * mean, minlength=1 << BITS) - 1e-6 * model.weights
        squares += grad ** 2
        square_b += gap.sum() ** 2
        model.weights += rate * grad / np.sqrt(squares)
        model.bias += rate * gap.sum() / np.sqrt(square_b)
    return model


# ---------------------------------------------------------------- Spark

_VOTES = pa.list_(pa.int8())


def voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch):
            data, at = utf8(part.column("text"))
            v = votes_of(Words(data, at), data)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(v), _VOTES)], names=["doc_id", "votes"])


def vote(docs: DataFrame) -> DataFrame:
    """(doc_id, votes) of every row, votes in the order of LABELLERS."""
    return docs.select("doc_id", "text").mapInArrow(voter, "doc_id long, votes array<tinyint>")


def fit(docs: DataFrame, max_rows: int = 4000) -> Model:
    """Label model from the vote patterns of all documents, scorer from a bounded sample."""
    patterns = vote(docs).groupBy("votes").count().collect()      # at most 3^labellers rows
    if not patterns:
        return Model(LabelModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3)), np.zeros(1 << BITS), 0.0)
    patterns.sort(key=lambda r: r["votes"])
    labels = expectation_maximisation(np.array([r["votes"] for r in patterns]), np.array([float(r["count"]) for r in patterns]))
    ids = (docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
           .orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max_rows).collect())
    ids = docs.sparkSession.createDataFrame(ids, "doc_id long")    # at most max_rows
    rows = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id")
            .agg(F.min("text").alias("text")).orderBy("doc_id").collect())
    return train_scorer([r["text"] for r in rows], labels)


def scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in parts(batch):
                data, at = utf8(part.column("text"))
                words = Words(data, at)
                v = votes_of(words, data)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(v), _VOTES), pa.array(model.labels.posterior(v)),
                     pa.array(model.score(words, data))], names=[*part.schema.names, "votes", "posterior", "score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with votes, posterior (of the label model) and score (of the scorer; 1: good)."""
    kept = docs.drop("votes", "posterior", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("votes", T.ArrayType(T.ByteType())),
                           T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)       # 2^BITS weights: 2 MB
    return kept.mapInArrow(scorer(shared), schema)
