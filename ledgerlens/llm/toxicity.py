"""Toxicity: a linear-chain conditional random field tags toxic spans.

Two tags (clean, toxic) over the tokens of a text: runs of ASCII letters, digits
and bytes above 0x7F, A-Z lower-cased.  A token's emission is the sum of the
hashed weights of the token, its first four, five and six bytes, its last three
bytes and a bias; transitions are a 2 x 2 table.  Forward-backward gives every
token's exact marginal; runs of tokens with a marginal of a half or more are the
offending spans, and a logistic of the strongest token and the expected number of
offending tokens is the document's score.

Labels are per document, so tokens are labelled first, on one text of each group of
near copies of one label in the sample: in a toxic document, a token is toxic if it (or its first bytes) stands in toxic documents far more often
than chance allows (binomial bound, corrected for the number of values tried).

Fitting uses a bounded, documented sample: at most ``max_toxic`` toxic and
``max_clean`` clean labelled rows, the smallest hashes of doc_id, never held-out
rows.  Scoring is one pass of a vectorized function over every whole text: no
shuffle, and neither labels, lang, source nor doc_id enter a score.

With two tags the forward recursion of the ratio toxic : clean is a Moebius map per
token, so a batch of texts is cut into equal blocks whose maps are multiplied side
by side; the blocks are then chained.  Exact for texts of any length.

Cases: null or empty texts and texts without tokens get the score of no evidence
and no span.  Null doc_id: scored, never held out, never used to fit.  Rows with
labels but no text, repeated or contradicting labels: the largest label counts.  No
toxic or no clean labels: all scores 0.  Repeated rows get equal scores.  Other
columns pass through; columns named like the results (score, spans) are replaced.
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

BITS = 20
FOLDS = 5
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of the span that each hashed feature covers: whole token, first n, last n.
FEATURES = (("all", 0), ("first", 4), ("first", 5), ("first", 6), ("last", 3))
BLOCK = 128
#: Bytes of text that fitting works on at once (on the driver).
FIT_BYTES = 1 << 18
#: Share of two texts' distinct tokens that makes them near copies.
COPY = 0.8


@dataclass
class Model:
    weights: np.ndarray          # 2^BITS + 1, the last is the bias
    trans: np.ndarray            # trans[from, to], logs
    doc: np.ndarray              # bias, strongest token, expected count
    empty: bool = False


def tokens(data: np.ndarray, at: np.ndarray) -> Words:
    low = lowered(data)
    return Words(low, at, inside=_TOKEN[low])


def feature_rows(words: Words) -> np.ndarray:
    """(features, tokens) indexes into the weights."""
    sums = Sequences(_BYTE[words.data])
    out = []
    for n, (kind, width) in enumerate(FEATURES):
        start, end = words.start, words.end
        if kind == "first":
            end = np.minimum(end, start + width)
        elif kind == "last":
            start = np.maximum(start, end - width)
        out.append((sums.spans(start, end) ^ np.uint64(n * 0x51ED270B)) & np.uint64((1 << BITS) - 1))
    return np.array(out).astype(np.int64)


def _chain(m: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Ratios r[t] = (m0 + m1 r[t-1]) / (m2 + m3 r[t-1]); where ``reset``, r[t-1] does not count.

    ``m`` is (4, tokens).  Blocks of BLOCK tokens are multiplied side by side, chained
    through their products, and then run side by side from their true beginning.
    """
    n = m.shape[1]
    blocks = max(1, -(-n // BLOCK))
    full = np.empty((4, blocks * BLOCK))
    full[:, :n], full[:, n:] = m, np.array([[0.0], [1.0], [1.0], [0.0]])       # beyond the end: r -> r
    full[1, :n][reset] = 0.0
    full[3, :n][reset] = 0.0
    a, b, c, d = full.reshape(4, blocks, BLOCK).transpose(0, 2, 1).copy()      # step j of all blocks side by side
    # r = (p + q s) / (u + v s) of what stands before the block
    p, q, u, v = np.zeros(blocks), np.ones(blocks), np.ones(blocks), np.zeros(blocks)
    for j in range(BLOCK):
        p, q, u, v = a[j] * u + b[j] * p, a[j] * v + b[j] * q, c[j] * u + d[j] * p, c[j] * v + d[j] * q
        scale = 1.0 / np.maximum(u, p)
        p, q, u, v = p * scale, q * scale, u * scale, v * scale
    r, begin = 0.0, np.empty(blocks)
    for k, (p0, q0, u0, v0) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), v.tolist())):
        begin[k] = r
        r = min((p0 + q0 * r) / max(u0 + v0 * r, 1e-300), 1e100)
    out, r = np.empty((BLOCK, blocks)), begin
    for j in range(BLOCK):
        r = np.minimum((a[j] + b[j] * r) / (c[j] + d[j] * r), 1e100)
        out[j] = r
    return out.T.reshape(-1)[:n]


START = np.log(0.01)


def forward_backward(emission: np.ndarray, first: np.ndarray, last: np.ndarray,
                     trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of toxic per token, and the forward and backward ratios.

    ``first``/``last`` mark the first and last token of each text.
    """
    e = np.exp(np.clip(emission, -30, 30))
    (oo, ot), (to, tt) = np.exp(trans)
    n = len(e)
    one = np.ones(n)
    fwd = np.where(first, np.stack([e * np.exp(START), 0 * e, one, 0 * e]), np.stack([e * ot, e * tt, oo * one, to * one]))
    rho = _chain(fwd, first)
    ahead = np.append(e[1:], 1.0)
    # backward, from the last token: tau[t] = (to + tt e[t+1] tau[t+1]) / (oo + ot e[t+1] tau[t+1])
    back = np.where(last, np.stack([one, 0 * e, one, 0 * e]), np.stack([to * one, tt * ahead, oo * one, ot * ahead]))
    tau = _chain(back[:, ::-1], last[::-1])[::-1]
    odds = rho * tau
    return odds / (1 + odds), rho, tau


def _edges(words: Words) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(words), dtype=bool)
    last = np.zeros(len(words), dtype=bool)
    filled = words.first[1:] > words.first[:-1]
    first[words.first[:-1][filled]] = True
    last[words.first[1:][filled] - 1] = True
    return first, last


def _emission(model: Model, features: np.ndarray) -> np.ndarray:
    return model.weights[features].sum(axis=0) + model.weights[-1]


def _doc_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 3): bias, log-odds of the strongest token, log of 1 + expected offending tokens.
    ``first`` is the first token of each text, and the end."""
    n = len(first) - 1
    top, count = np.full(n, 1e-6), np.zeros(n)
    text = np.repeat(np.arange(n), np.diff(first))
    np.maximum.at(top, text, p)
    np.add.at(count, text, np.where(p >= 0.5, p, 0.0))
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(count)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _spans(p: np.ndarray, words: Words) -> list[list[dict]]:
    """Runs of offending tokens per text, as code point offsets."""
    hot = p >= 0.5
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    if not hot.any():
        return out
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    begin = hot.copy()
    begin[1:] &= ~hot[:-1] | (words.row[1:] != words.row[:-1])
    at = np.flatnonzero(begin)
    ends = np.append(at[1:], len(hot))
    for a, b in zip(at, ends):
        b = a + int(np.argmin(hot[a:b])) if not hot[a:b].all() else b
        row = words.row[a]
        zero = points[words.at[row]]
        out[row].append({"start": int(points[words.start[a]] - zero), "end": int(points[words.end[b - 1]] - zero),
                         "score": float(p[a:b].max())})
    return out


# ---------------------------------------------------------------- fitting

def _word_parts(texts: list[str | None]) -> Iterator[Words]:
    """The texts' tokens, a bounded part at a time."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for part in parts(batch, most=FIT_BYTES):
        yield tokens(*utf8(part.column("text")))


def _token_hashes(words: Words) -> np.ndarray:
    return Sequences(_BYTE[words.data]).spans(words.start, words.end)


def distinct_texts(texts: list[str | None], labels: np.ndarray) -> np.ndarray:
    """Which texts are not near copies of an earlier one that stays, of the same label: ``COPY`` of the
    distinct tokens of both in common.  Texts without tokens do not count as distinct.

    A copied text would make all of its words look typical of its label.  Texts are compared if they share
    a band of three of twelve MinHashes and seven of all."""
    low, sets, at, n = [], [], [], 0
    for words in _word_parts(texts):
        filled = np.flatnonzero(np.diff(words.first))
        if len(filled):
            h = _token_hashes(words)
            low.append(np.stack([np.minimum.reduceat(mix64(h ^ np.uint64(0x9E37 * (k + 1))), words.first[filled])
                                 for k in range(12)]))
            sets += [np.unique(h[words.first[i]:words.first[i + 1]]) for i in filled]
            at.append(filled + n)
        n += len(words.first) - 1
    fresh = np.zeros(len(texts), dtype=bool)
    if at:
        at, low = np.concatenate(at), np.concatenate(low, axis=1).T.copy()
        kept: dict[tuple, list[int]] = {}
        for i, where in enumerate(at):
            bands = [(labels[where], band, low[i, band:band + 3].tobytes()) for band in range(0, 12, 3)]
            met = np.unique(np.concatenate([np.array(kept.get(b, ()), dtype=np.int64) for b in bands]))
            met = met[(low[met] == low[i]).sum(axis=1) >= 7]
            for j in met:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= COPY * (len(sets[i]) + len(sets[j]) - both):
                    break
            else:
                fresh[where] = True
                for b in bands:
                    kept.setdefault(b, []).append(i)
    return fresh


def token_labels(features: np.ndarray, pairs: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which distinct tokens are toxic in toxic texts: those with a value far more common there than
    by chance.  ``pairs`` are the distinct (token, text)."""
    share = toxic.mean()
    label = np.zeros(features.shape[1], dtype=bool)
    for values in features[:4]:
        value, text = np.divmod(np.unique(values[pairs[0]].astype(np.int64) * len(toxic) + pairs[1]), len(toxic))   # once per text
        total = np.bincount(value, minlength=1 << BITS)
        bad = np.bincount(value, weights=toxic[text], minlength=1 << BITS)
        rate = bad / np.maximum(total, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = np.where(rate > 0, rate * np.log(rate / share), 0) \
                + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0)
        tried = max(2, int((total >= 3).sum()))
        strong = (rate >= max(0.9, share)) & (total * kl > np.log(tried / 0.01))
        label |= strong[values]
    return label


def fit(texts: list[str | None], toxic: list[int], rounds: int = 20, rate: float = 0.5, l2: float = 1e-6) -> Model:
    """Train the field by full-batch adaptive gradient steps on the exact likelihood."""
    weights, trans = np.zeros((1 << BITS) + 1), np.log(np.array([[0.99, 0.01], [0.5, 0.5]]))
    model = Model(weights, trans, np.zeros(3))
    toxic = np.array(toxic, dtype=float)
    once = distinct_texts(texts, toxic)
    texts, toxic = [t for t, keep in zip(texts, once) if keep], toxic[once]
    if not len(toxic) or toxic.min() == toxic.max():
        model.empty = True
        return model
    # equal tokens have equal features: emissions and gradients are taken once per distinct token
    hashes, firsts, kinds, found = [], [], [], []
    for words in _word_parts(texts):
        h = _token_hashes(words)
        _, where = np.unique(h, return_index=True)
        hashes.append(h)
        firsts.append(words.first)
        kinds.append(h[where])
        found.append(feature_rows(words)[:, where].astype(np.int32))
    kinds, where = np.unique(np.concatenate(kinds), return_index=True)
    features = np.concatenate(found, axis=1)[:, where]
    batches, pairs, n = [], [], 0
    for h, first_of in zip(hashes, firsts):
        kind = np.searchsorted(kinds, h).astype(np.int32)
        text = np.repeat(np.arange(len(first_of) - 1, dtype=np.int32) + n, np.diff(first_of))
        n += len(first_of) - 1
        first, last = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
        first[first_of[:-1]] = True                  # every distinct text has tokens
        last[first_of[1:] - 1] = True
        batches.append((kind, text, first, last, first_of))
        pairs.append(np.unique(kind.astype(np.int64) * len(toxic) + text))
    del hashes, found
    pairs = np.stack(np.divmod(np.concatenate(pairs), len(toxic)))
    strong = token_labels(features, pairs, toxic)
    weights[-1] = -2.0
    squares, squares_t = np.full(len(weights), 1e-6), np.full((2, 2), 1e-6)
    n_tokens = sum(len(b[0]) for b in batches)
    for _ in range(rounds):
        gap, step_t = np.zeros(len(kinds)), np.zeros((2, 2))
        by_kind, a = _emission(model, features), np.exp(trans)
        for kind, text, first, last, _ in batches:
            y = (strong[kind] & (toxic[text] > 0)).astype(float)
            p, rho, tau = forward_backward(by_kind[kind], first, last, trans)
            gap += np.bincount(kind, weights=y - p, minlength=len(kinds))
            here = np.flatnonzero(~first)            # tokens with a predecessor in their text
            prev = here - 1
            e = np.exp(np.clip(by_kind[kind[here]], -30, 30))
            cells = np.stack([np.full(len(here), a[0, 0]), a[0, 1] * e * tau[here],
                              a[1, 0] * rho[prev], a[1, 1] * rho[prev] * e * tau[here]])
            expected = (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
            was, now = np.stack([1 - y[prev], y[prev]]), np.stack([1 - y[here], y[here]])
            step_t += was @ now.T - expected
        grad = -l2 * n_tokens * weights
        for f in features:
            np.add.at(grad, f, gap)
        grad[-1] += gap.sum()
        squares += grad ** 2
        squares_t += step_t ** 2
        weights += rate * grad / np.sqrt(squares)
        trans += 0.1 * step_t / np.sqrt(squares_t)
    by_kind = _emission(model, features)
    x = np.concatenate([_doc_features(forward_backward(by_kind[kind], first, last, trans)[0], first_of)
                        for kind, _, first, last, first_of in batches])
    for _ in range(25):                              # Newton steps of the document logistic
        q = _sigmoid(x @ model.doc)
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        model.doc += np.linalg.solve(h, x.T @ (toxic - q) - 1e-2 * model.doc)
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, max_toxic: int = 1200, max_clean: int = 2400) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    marked = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    there = marked.join(docs.filter(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    pick = lambda c, n: there.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = (pick(F.col("toxic") == 1, max_toxic).unionByName(pick(F.col("toxic") == 0, max_clean)))
    ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, toxic int")      # at most the two bounds
    rows = (docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect())
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


# ---------------------------------------------------------------- scoring

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                 T.StructField("score", T.DoubleType())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scorer(shared, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in parts(batch):
                words = tokens(*utf8(part.column("text")))
                n = part.num_rows
                if model.empty:
                    score, spans = np.zeros(n), [[] for _ in range(n)]
                else:
                    p = np.zeros(0)
                    if len(words):
                        p = forward_backward(_emission(model, feature_rows(words)), *_edges(words), model.trans)[0]
                    score, spans = _sigmoid(_doc_features(p, words.first) @ model.doc), _spans(p, words)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(spans, _SPAN)],
                                                 names=[*part.schema.names, *names])
    return run


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans`` (start, end in code points, score), or other ``names``;
    columns of these names give way."""
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], SPAN)])
    shared = docs.sparkSession.sparkContext.broadcast(model)       # 2^BITS weights: 8 MB
    return kept.mapInArrow(scorer(shared, names), schema)
