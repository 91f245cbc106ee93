"""Hard negatives of anchors by the threshold algorithm over sorted lists.

Components become integers, floor(scale * x); a row's score is its integer inner product
with the anchor, higher first, ties by the smaller id.  An anchor's positives are its best
rows of the same label.  Its negatives for a positive are the best rows of other labels
whose score lies in a window below the positive's (``low``..``high`` per cent of it).

1. Rows lie in blocks, for the positives of one label each, with one sorted list per
   dimension.  Every block meets the anchors, block by block as well (the anchors are the
   stated query set), so neither a label nor a block grows with a group of copies.
2. In a block an anchor reads all lists side by side, each from the end its own sign makes
   best (a list of a zero component tells nothing and is not read); every row met is
   scored as a whole.  The rows at the present depth bound the score of all rows not met.
   The search stops once that bound lies strictly below the worst score each window
   keeps (ties are then settled), or below the window itself.
3. The best rows of the blocks are merged to those of the anchor: first for the positives,
   then, with their scores as windows, for the negatives.

Scores are exact: in doubles where their bound stays below 2^53, else in Python's integers;
components and scores beyond a long are taken as its ends.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part;
an empty vector scores 0.  Vectors meet only those of their length.  Equal rows count
once; rows that share an id but differ are rows of their own (ties after the id go by a hash of
the row).  A row without an id is no anchor; as a candidate it comes after all ids of its score.
A positive below zero has no window.  Empty table: no rows.  Only vec_id, label and embedding are
read, so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged

LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Mining:
    scale: float = 256.0
    positives: int = 5
    negatives: int = 3
    low: int = 50                   # per cent of the positive's score
    high: int = 95
    block_rows: int = 8192
    block_anchors: int = 2048
    block_values: int = 1 << 22     # components of a block at most (or one row)
    first_depth: int = 16           # of the lists; the depth doubles from there


# ---------------------------------------------------------------- rows

def usable_rows(vectors: DataFrame, m: Mining) -> DataFrame:
    """(id, label, v, length, h): distinct rows that take part, with integer components."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    integer = F.transform("embedding", lambda x: F.floor(x.cast("double") * m.scale).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("label"), integer.alias("v")).distinct()
    return rows.select("id", "label", "v", F.size("v").alias("length"), F.xxhash64("id", "label", "v").alias("h"))


def _meet(rows: DataFrame, anchors: DataFrame, by: list[str], m: Mining):
    """Cogroup of the blocks of rows and of anchors with equal ``by``."""
    most = lambda n: F.greatest(F.lit(1), F.least(F.lit(n), F.floor(m.block_values / F.greatest(F.col("length"), F.lit(1)))))
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / most(m.block_rows)).cast("int").alias("row_blocks"))
    some = anchors.groupBy(*by).agg(F.ceil(F.count("*") / most(m.block_anchors)).cast("int").alias("anchor_blocks"))
    sizes = staged(sizes.join(some, by), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("h", F.lit("block")), F.col(n)).cast("int")
    row_sizes = sizes if "label" in by else sizes.select("length", "row_blocks", "anchor_blocks")
    left = rows.join(row_sizes, by).withColumn("rb", own("row_blocks")).withColumn("ab", every("anchor_blocks"))
    right = anchors.join(row_sizes, by).withColumn("ab", own("anchor_blocks")).withColumn("rb", every("row_blocks"))
    key = [*by, "rb", "ab"]
    return left.drop("row_blocks", "anchor_blocks").groupBy(*key).cogroup(right.drop("row_blocks", "anchor_blocks").groupBy(*key))


# ---------------------------------------------------------------- one block

def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)


def exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if no sum of products can pass 2^53, else as Python's integers."""
    largest = lambda a: max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0
    small = largest(x) * largest(q) * max(1, x.shape[1]) < 1 << 53
    return (x.astype(np.float64), q.astype(np.float64)) if small else (x.astype(object), q.astype(object))


class Lists:
    """A block's rows with the sorted list of every dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)

    def read(self, q: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Rows at the depths ``begin``..``end`` of the lists, from each list's better end."""
        n = len(self.x)
        met = np.zeros(n, dtype=bool)
        met[self.order[begin:end][:, q < 0]] = True
        met[self.order[n - end:n - begin][:, q > 0]] = True
        return met

    def bound(self, q: np.ndarray, depth: int):
        """No row that no list shows down to ``depth`` scores more."""
        return self.sorted[depth - 1][q < 0] @ q[q < 0] + self.sorted[len(self.x) - depth][q > 0] @ q[q > 0]


def search(lists: Lists, q: np.ndarray, wanted, first_depth: int) -> int:
    """Sorted access until ``wanted`` is settled; gives it every row met with its score, returns the depth."""
    n, depth = len(lists.x), 0
    seen = np.zeros(n, dtype=bool)
    if not (q != 0).any():
        wanted.take(np.arange(n), np.zeros(n, dtype=np.int64))
        return n
    while depth < n:
        end = min(n, max(first_depth, 2 * depth))
        new = np.flatnonzero(lists.read(q, depth, end) & ~seen)
        seen[new] = True
        scores = lists.x[new] @ q
        wanted.take(new, scores if scores.dtype == object else scores.astype(np.int64))
        depth = end
        if wanted.settled(lists.bound(q, depth)):
            break
    return depth


class Best:
    """The best ``k`` rows in a window of scores (None: open), ties by the rows' ``order``."""

    def __init__(self, k: int, order: np.ndarray, allowed: np.ndarray, positive=None, low: int = 0, high: int = 0):
        self.k, self.order, self.allowed = k, order, allowed
        self.positive, self.low, self.high = positive, low, high
        self.rows, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def take(self, rows: np.ndarray, scores: np.ndarray) -> None:
        fits = self.allowed[rows]
        if self.positive is not None:
            hundred = scores.astype(object) * 100 if scores.dtype == object else scores * 100
            fits &= (hundred >= self.low * self.positive).astype(bool) & (hundred <= self.high * self.positive).astype(bool)
        if len(self.rows) == self.k:
            fits &= (scores >= self.scores[-1]).astype(bool)
        if not fits.any():
            return
        rows, scores = np.concatenate([self.rows, rows[fits]]), np.concatenate([self.scores, scores[fits]])
        best = np.lexsort((self.order[rows], -scores))[:self.k] if scores.dtype != object else np.array(
            sorted(range(len(rows)), key=lambda i: (-scores[i], self.order[rows[i]]))[:self.k], dtype=np.int64)
        self.rows, self.scores = rows[best], scores[best]

    def settled(self, bound) -> bool:
        if len(self.rows) == self.k and bound < self.scores[-1]:
            return True
        return self.positive is not None and 100 * int(bound) < self.low * self.positive


class Windows:
    """Several windows filled by one search."""

    def __init__(self, windows: list[Best]):
        self.windows = windows

    def take(self, rows, scores):
        for w in self.windows:
            w.take(rows, scores)

    def settled(self, bound) -> bool:
        return all(w.settled(bound) for w in self.windows)


def _block(rows: pa.Table) -> tuple:
    """(ids, hashes, place of every row in the order of ids, then hashes; ids missing last)."""
    ids, h = rows["id"].to_pandas().to_numpy(), rows["h"].to_numpy()
    missing = rows["id"].is_null().to_numpy()
    number = rows["id"].fill_null(0).to_numpy()
    place = np.empty(len(h), dtype=np.int64)
    place[np.lexsort((h, number, missing))] = np.arange(len(h))
    return ids, h, place


def _clipped(scores: list) -> pa.Array:
    return pa.array([min(max(int(s), LONG.min), LONG.max) for s in scores], type=pa.int64())


def nearest_same(m: Mining):
    """Cogroup: a block of one label, and anchors of the label -> their best other rows there."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            _, h, place = _block(rows)
            x, queries = exact(matrix(rows["v"], rows.num_rows), matrix(anchors["v"], anchors.num_rows))
            lists = Lists(x)
            ids, row_ids = anchors["id"].to_pylist(), rows["id"].to_pylist()
            by_hash = {}
            for i, value in enumerate(h.tolist()):
                by_hash.setdefault(value, []).append(i)
            for a, (anchor, own) in enumerate(zip(ids, anchors["h"].to_pylist())):
                allowed = np.ones(len(h), dtype=bool)
                for i in by_hash.get(own, ()):        # the anchor itself
                    allowed[i] = not (row_ids[i] == anchor and (x[i] == queries[a]).all())
                best = Best(m.positives, place, allowed)
                search(lists, queries[a], best, m.first_depth)
                out += [(anchor, own, row_ids[i], int(h[i]), s) for i, s in zip(best.rows, best.scores)]
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, type=pa.int64()) for c in columns[:4]] + [_clipped(columns[4])],
                        names=["anchor_id", "anchor_h", "id", "h", "score"])
    return run


def nearest_other(m: Mining):
    """Cogroup: a block of rows, and anchors with their positives' scores -> the best rows of other labels in each window."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            _, h, place = _block(rows)
            x, queries = exact(matrix(rows["v"], rows.num_rows), matrix(anchors["v"], anchors.num_rows))
            lists = Lists(x)
            row_ids, labels = rows["id"].to_pylist(), np.array(rows["label"].to_pylist(), dtype=object)
            columns = (anchors[c].to_pylist() for c in ("id", "h", "label", "positive_scores"))
            for a, (anchor, own, label, scores) in enumerate(zip(*columns)):
                allowed = (labels != label).astype(bool)
                windows = [Best(m.negatives, place, allowed, s, m.low, m.high) for s in scores]
                search(lists, queries[a], Windows(windows), m.first_depth)
                out += [(anchor, own, w.positive, row_ids[i], int(h[i]), s) for w in windows for i, s in zip(w.rows, w.scores)]
        columns = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, type=pa.int64()) for c in columns[:5]] + [_clipped(columns[5])],
                        names=["anchor_id", "anchor_h", "positive_score", "id", "h", "score"])
    return run


# ---------------------------------------------------------------- all blocks

def _ranked(found: DataFrame, key: list[str], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("id"), "h"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, m: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on ``id``."""
    rows = staged(usable_rows(vectors, m), "integer-vectors")
    anchors = staged(rows.filter(is_anchor & F.col("id").isNotNull()), "anchors")
    found = (_meet(rows, anchors, ["length", "label"], m)
             .applyInArrow(nearest_same(m), "anchor_id long, anchor_h long, id long, h long, score long"))
    positives = staged(_ranked(found, ["anchor_id", "anchor_h"], m.positives), "positives")
    windows = (positives.filter(F.col("score") >= 0).groupBy(F.col("anchor_id").alias("id"), F.col("anchor_h").alias("h"))
               .agg(F.array_sort(F.collect_set("score")).alias("positive_scores")))      # at most ``positives`` each
    found = (_meet(rows, anchors.join(windows, ["id", "h"]), ["length"], m)
             .applyInArrow(nearest_other(m), "anchor_id long, anchor_h long, positive_score long, id long, h long, score long"))
    negatives = _ranked(found, ["anchor_id", "anchor_h", "positive_score"], m.negatives)
    pairs = positives.select("anchor_id", "anchor_h", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (pairs.join(negatives, ["anchor_id", "anchor_h", "positive_score"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
