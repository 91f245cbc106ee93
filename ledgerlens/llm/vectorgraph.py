"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors collapse to one row with the number of its copies.
2. Shards: pivots (a bounded sample of vectors, smallest hashes, none in range of another)
   split the vectors; each goes to its ``overlap`` nearest pivots and to those hardly further
   than the nearest (``slack``), so shards overlap.  A shard above ``shard_rows`` is split again
   the same way by pivots of its own, in as many rounds as it takes; a shard of which pivots
   leave more than half together (a dense group) is dealt to blocks, and every two of its
   blocks meet as one shard.
3. Graph: in a shard each vector's list is pruned from all others of the shard, nearest first:
   one goes if a kept one is nearer to it than the vector is (ties by position).  Such lists
   hold the shard's minimum spanning tree, so near and far groups stay joined, and their
   length follows from the data's dimension, not from a cap.  A vector's lists from
   all its shards are united in a table.
4. Search: every vector of a shard looks for what is in range, from the shard's medoid over
   the united lists; it expands the best met so far while that is among its ``beam`` best,
   and everything in range.  Only pairs met are compared, each by its own product in double
   precision, so a link is decided alike wherever it is met.
5. Links stay in the task: a pair is counted in the first of the shards that both share, and a
   shard returns a row per vector: the numbers of its links and the smallest vector it
   is linked to over links of the shard.  Components are joined from those.
6. Audit: a bounded sample of vectors of each length is compared with all rows, block by block.
   Recall is a mean over vectors, the worst over the lengths and over small and dense
   neighbourhoods; while it is below ``min_recall`` the shards are made again with one more
   overlap, and after ``max_overlap`` all pairs are compared, block by block
   (2 n^2 / ``exact_rows`` row copies).  The recall is logged and returned.

A shard is one task's group: ``shard_rows`` (``exact_rows`` where all pairs are compared) bounds
it whatever the data.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and
rows with a null id, link with nothing and are their own component (null id: null).
Vectors of different lengths link with nothing of another length.  Equal rows count
as one; different vectors that share an id are vectors of their own with that id.  Empty table: no
rows.  Only vec_id and embedding are read, so further columns cannot clash.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged
from ledgerlens.llm.components import connected

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Graph:
    threshold: float = 0.9
    shard_rows: int = 1500          # vectors of a shard at most
    pivots: int = 512               # that a shard is split by at once, at most
    overlap: int = 2
    slack: float = 0.05             # radians beyond the nearest pivot
    audit_rows: int = 500
    min_recall: float = 0.99
    max_overlap: int = 6
    beam: int = 24                  # of the best met, where a search goes on outside the range
    exact_rows: int = 6000          # vectors of two blocks where all pairs are compared


def unit(vectors) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding: str = "embedding"):
    v = F.col(embedding)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def named(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding in doubles, node): ``node`` names the vector, null where it links with nothing."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("embedding"))
    return rows.withColumn("node", F.when(usable() & F.col("vec_id").isNotNull(), F.xxhash64("embedding")))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(node, embedding, first id, copies: its distinct ids)."""
    some = rows.filter(F.col("node").isNotNull()).distinct()
    return some.groupBy("node", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))


# ---------------------------------------------------------------- shards

def apart(pivots: np.ndarray, threshold: float) -> np.ndarray:
    """Positions of pivots none of which is in range of an earlier one."""
    kept: list[int] = []
    for i in range(len(pivots)):
        if not kept or (pivots[kept] @ pivots[i]).max() < threshold:
            kept.append(i)
    return np.array(kept)


def _nearest_pivots(g: Graph, overlap: int):
    """Cogroup: rows of a part of a shard, and the shard's pivots -> rows per near pivot."""
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(pivots):
            return pd.DataFrame({"shard": pd.Series(dtype="str"), "node": pd.Series(dtype="int64"),
                                 "embedding": pd.Series(dtype="object"), "was": pd.Series(dtype="int64")})
        pivots = pivots.sort_values("node")
        pivots = pivots.iloc[apart(unit(pivots["embedding"]), g.threshold)]
        angle = np.arccos(np.clip(unit(rows["embedding"]) @ unit(pivots["embedding"]).T, -1, 1))
        order = np.sort(angle, axis=1)
        reach = np.maximum(order[:, min(overlap, len(pivots)) - 1], order[:, 0] + g.slack)
        take, pivot = np.nonzero(angle <= reach[:, None])
        names = pivots["node"].astype(str).to_numpy()[pivot]
        return pd.DataFrame({"shard": rows["shard"].to_numpy()[take] + "/" + names, "node": rows["node"].to_numpy()[take],
                             "embedding": rows["embedding"].to_numpy()[take], "was": rows["n"].to_numpy()[take]})
    return run


def _blocks_of(rows: DataFrame, sizes: DataFrame, shard_rows: int) -> DataFrame:
    """Deal a shard to blocks of half a shard; every pair of blocks becomes a shard."""
    half = max(1, shard_rows // 2)
    rows = rows.join(sizes.select("shard", F.ceil(F.col("n") / half).cast("int").alias("blocks")), "shard")
    rows = rows.select("shard", "node", "embedding", "blocks").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.filter((F.col("other") != F.col("own")) | (F.col("blocks") == 1))
    name = F.concat_ws("#", "shard", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(name.alias("shard"), "node", "embedding", F.col("own").alias("block"))


def shards(vectors: DataFrame, g: Graph, overlap: int) -> DataFrame:
    """(shard, node, embedding, block): overlapping shards of at most about ``shard_rows`` vectors;
    ``block`` is -1 but in the pairs of blocks of a dense group."""
    schema = "shard string, node long, embedding array<double>, was long"
    # vectors of another length are another space
    todo = vectors.select(F.size("embedding").cast("string").alias("shard"), "node", "embedding",
                          F.lit(None).cast("long").alias("was"))
    done = None
    while True:
        sizes = staged(todo.groupBy("shard").agg(F.count("*").alias("n"), F.max("was").alias("of")), "shard-sizes")
        small, large = F.col("n") <= g.shard_rows, F.col("n") > g.shard_rows
        dense = large & F.coalesce(F.col("n") > 0.5 * F.col("of"), F.lit(False))
        ready = todo.join(sizes.filter(small).select("shard"), "shard", "left_semi").select(
            "shard", "node", "embedding", F.lit(-1).alias("block"))
        done = ready if done is None else done.unionByName(ready)
        n_dense, n_split = sizes.agg(F.count(F.when(dense, 1)), F.count(F.when(large & ~dense, 1))).first()
        if n_dense:
            done = done.unionByName(_blocks_of(todo, sizes.filter(dense), g.shard_rows))
        if not n_split:
            return staged(done, "shards")
        rows = todo.select("shard", "node", "embedding").join(sizes.filter(large & ~dense).select("shard", "n"), "shard")
        # as many pivots as make small shards, at most ``pivots``; parts of a shard are dealt to several tasks
        k = F.least(F.lit(g.pivots), F.ceil(4.0 * overlap * F.col("n") / g.shard_rows) + 1)
        share = g.pivots * 8.0 / F.col("n")                     # a thin hash slice holds the smallest hashes
        thin = rows.filter(F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 30)) < share * (1 << 30))
        first = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("node").alias("h"), "node", "embedding"))), 1, g.pivots)
        pivots = (thin.groupBy("shard", "n").agg(first.alias("p"))
                  .select("shard", F.ceil(F.col("n") / 20_000).cast("int").alias("parts"),
                          F.slice("p", F.lit(1), k.cast("int")).alias("p"))
                  .select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.explode("p").alias("p"))
                  .select("shard", "part", "p.node", "p.embedding"))
        pivots = staged(pivots, "pivots")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / 20_000)).cast("int"))
        todo = staged(rows.groupBy("shard", "part").cogroup(pivots.groupBy("shard", "part"))
                      .applyInPandas(_nearest_pivots(g, overlap), schema), "split")


# ---------------------------------------------------------------- graph

def robust_prune(sims: np.ndarray) -> list[np.ndarray]:
    """Lists of one shard from its cosines: of all others, nearest first, those that no kept one is nearer to."""
    sims = np.minimum(sims, sims.T)
    out = []
    for i in range(len(sims)):
        left = np.argsort(-sims[i], kind="stable")
        left = left[left != i]
        kept: list[int] = []
        while len(left):
            p, left = left[0], left[1:]
            kept.append(int(p))
            theirs, mine = sims[p, left], sims[i, left]
            left = left[(theirs < mine) | ((theirs == mine) & (i < p))]
        out.append(np.array(kept, dtype=np.int64))
    return out


def prune_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, neighbours) of a shard; a neighbour has the vector in its own list, too."""
    x, nodes = unit(rows["embedding"]), rows["node"].to_numpy()
    lists = robust_prune(x @ x.T)
    one = np.repeat(np.arange(len(x)), [len(a) for a in lists])
    other = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    one, other = np.concatenate([one, other]), np.concatenate([other, one])
    order = np.argsort(one, kind="stable")
    cuts = np.cumsum(np.bincount(one, minlength=len(x)))[:-1]
    return pd.DataFrame({"node": nodes, "neighbours": [np.unique(a) for a in np.split(nodes[other[order]], cuts)]})


# ---------------------------------------------------------------- search

def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row product, alike for a pair wherever it is met."""
    step = max(1, (1 << 20) // max(1, a.shape[1]))
    return np.concatenate([np.einsum("ij,ij->i", a[s:s + step], b[s:s + step]) for s in range(0, len(a), step)] or [np.zeros(0)])


def search(x: np.ndarray, lists: list[np.ndarray], start: int, threshold: float, beam: int) -> np.ndarray:
    """Which vectors each vector finds in range (a square matrix), all searches side by side.

    A search meets itself and ``start``; in every round it expands everything in range
    that it has not expanded yet, and the best other one while that is among the ``beam`` best met."""
    n = len(x)
    width = max([len(a) for a in lists] + [1])
    adjacent = np.full((n, width), -1, dtype=np.int64)
    for i, a in enumerate(lists):
        adjacent[i, :len(a)] = a
    seen, linked = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)
    outside = np.full((n, n), -2.0, dtype=np.float32)       # met, out of range, not expanded yet
    pool = np.full((n, beam), -2.0, dtype=np.float32)       # the best met
    todo = np.zeros((n, n), dtype=bool)                     # in range, not expanded yet

    def meet(met: np.ndarray) -> None:
        rows, nodes = np.nonzero(met & ~seen)
        if not len(rows):
            return
        step = 1 << 18
        sim = np.concatenate([products(x[rows[s:s + step]], x[nodes[s:s + step]]) for s in range(0, len(rows), step)])
        seen[rows, nodes] = True
        near = sim >= threshold
        linked[rows[near], nodes[near]] = True
        todo[rows[near], nodes[near]] = True
        outside[rows[~near], nodes[~near]] = sim[~near]
        touched, first = np.unique(rows, return_index=True)
        for r, some in zip(touched, np.split(sim, first[1:])):
            pool[r] = -np.partition(-np.concatenate([pool[r], some]), beam - 1)[:beam]

    met = np.eye(n, dtype=bool)
    met[:, start] = True
    meet(met)
    while True:
        expand = todo.copy()
        todo[:] = False
        best = np.argmax(outside, axis=1)
        value = outside[np.arange(n), best]
        go = np.flatnonzero((value > -2.0) & (value >= pool.min(axis=1)))
        expand[go, best[go]] = True
        outside[go, best[go]] = -2.0
        rows, nodes = np.nonzero(expand)
        if not len(rows):
            return linked
        met = np.zeros((n, n), dtype=bool)
        for s in range(0, len(rows), 1 << 16):
            near = adjacent[nodes[s:s + (1 << 16)]]
            met[np.repeat(rows[s:s + (1 << 16)], width)[near.ravel() >= 0], near[near >= 0]] = True
        meet(met)


# ---------------------------------------------------------------- links

def summed(linked: np.ndarray, counted: np.ndarray, nodes: np.ndarray, copies: np.ndarray) -> pd.DataFrame:
    """(node, partners, others, root) of the vectors with a link: their counted partners, those with
    their copies, and the smallest node that links of the shard join them to."""
    root = nodes.copy()
    most = np.iinfo(np.int64).max
    while True:
        low = np.array([min(root[i], root[row].min(initial=most)) for i, row in enumerate(linked)], dtype=np.int64)
        if (low == root).all():
            break
        root = low
    has = linked.any(axis=1)
    return pd.DataFrame({"node": nodes[has], "partners": counted.sum(axis=1)[has], "others": (counted @ copies)[has], "root": root[has]})


def mine_of(block: np.ndarray, shard: str) -> np.ndarray:
    """Pairs that are this shard's among the pairs of blocks of a dense group: those of two blocks, and
    inside a block k those of (0, k), inside block 0 those of (0, 1) or of the only block."""
    n = len(block)
    if block[0] < 0:
        return np.ones((n, n), dtype=bool)
    low, high = map(int, shard.split("#")[1:])
    inside = ((block == high) & (low == 0)) | (high == 1) | (low == high)
    return (block[:, None] != block[None, :]) | inside[:, None]


def search_shard(g: Graph):
    """Links of a shard by search over the united lists."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        x, nodes = unit(rows["embedding"]), rows["node"].to_numpy()
        at = {int(v): i for i, v in enumerate(nodes)}
        lists = [np.array([at[v] for v in some.tolist() if v in at], dtype=np.int64) for some in rows["neighbours"]]
        medoid = int(np.argmax(x @ x.sum(axis=0)))
        linked = search(x, lists, medoid, g.threshold, g.beam)
        linked |= linked.T
        np.fill_diagonal(linked, False)
        # of the shards that a pair shares the first counts it
        own = int(rows["base"].iloc[0])
        earlier = [sorted({int(b) for b in some if b < own}) for some in rows["bases"]]
        number = {b: k for k, b in enumerate(sorted({b for some in earlier for b in some}))}
        member = np.zeros((len(x), len(number)), dtype=np.float32)
        for i, some in enumerate(earlier):
            member[i, [number[b] for b in some]] = 1
        counted = linked & mine_of(rows["block"].to_numpy(), rows["shard"].iloc[0])
        if len(number):
            counted &= member @ member.T == 0
        return summed(linked, counted, nodes, rows["copies"].to_numpy())
    return run


LINKS = "node long, partners long, others long, root long"


def find_links(distinct: DataFrame, sharded: DataFrame, g: Graph) -> DataFrame:
    """(node, partners, others, root): rows of every shard's links."""
    base = F.xxhash64(F.substring_index("shard", "#", 1))
    lists = sharded.groupBy("shard").applyInPandas(prune_shard, "node long, neighbours array<long>")
    united = staged(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "graph")
    places = sharded.select("node", base.alias("base")).groupBy("node").agg(F.collect_set("base").alias("bases"))
    of_node = united.join(places, "node").join(distinct.select("node", "copies"), "node")
    rows = sharded.withColumn("base", base).join(of_node, "node")
    return staged(rows.groupBy("shard").applyInPandas(search_shard(g), LINKS), "links")


def compare_shard(g: Graph):
    """Links of a shard by all its pairs."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, nodes = unit(rows["embedding"]), rows["node"].to_numpy()
        linked = np.zeros((len(x), len(x)), dtype=bool)
        for at in range(0, len(x), 512):
            # a hair below the threshold; the product of the pair alone decides
            i, j = np.nonzero(x[at:at + 512] @ x.T >= g.threshold - 1e-9)
            for s in range(0, len(i), 1 << 18):
                a, b = i[s:s + (1 << 18)] + at, j[s:s + (1 << 18)]
                true = products(x[a], x[b]) >= g.threshold
                linked[a[true], b[true]] = True
        np.fill_diagonal(linked, False)
        return summed(linked, linked & mine_of(rows["block"].to_numpy(), rows["shard"].iloc[0]), nodes, rows["copies"].to_numpy())
    return run


def every_pair(distinct: DataFrame, g: Graph) -> DataFrame:
    """Links as ``find_links`` gives them, from all pairs of vectors of one length."""
    rows = distinct.select(F.size("embedding").cast("string").alias("shard"), "node", "embedding")
    sizes = staged(rows.groupBy("shard").agg(F.count("*").alias("n")), "shard-sizes")
    blocks = _blocks_of(rows, sizes, g.exact_rows).join(distinct.select("node", "copies"), "node")
    return staged(blocks.groupBy("shard").applyInPandas(compare_shard(g), LINKS), "links")


# ---------------------------------------------------------------- audit

def count_true(threshold: float):
    """Cogroup: a block of vectors, and the sampled ones of their length -> partners there."""
    def run(rows: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(sample):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        x, q = unit(rows["embedding"]), unit(sample["embedding"])
        i, j = np.nonzero(x @ q.T >= threshold - 1e-9)
        own = rows["node"].to_numpy()[i] == sample["node"].to_numpy()[j]
        true = ~own & (products(x[i], q[j]) >= threshold)
        n = np.bincount(j[true], minlength=len(q))
        return pd.DataFrame({"node": sample["node"].to_numpy(), "n": n.astype(np.int64)})
    return run


def audit(distinct: DataFrame, links: DataFrame, g: Graph) -> float:
    """Mean share of a vector's links that were found, over ``audit_rows`` vectors of each length
    (smallest hashes) that have links; the worst mean over the lengths and the sizes of a
    vector's neighbourhood (1 to 3 links, 4 to 15, ...), so that no dense group speaks for the rest."""
    rows = distinct.select("node", "embedding", F.size("embedding").alias("length"))
    sizes = rows.groupBy("length").agg(F.count("*").alias("size"), F.ceil(F.count("*") / 6000).cast("int").alias("blocks"))
    sizes = staged(sizes, "audit-sizes")
    h = F.shiftrightunsigned(F.xxhash64("node", F.lit("audit")), 34)
    # a thin hash slice holds the smallest hashes
    thin = rows.join(sizes, "length").withColumn("h", h).filter(F.col("h") < g.audit_rows * 8.0 / F.col("size") * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("length").orderBy("h", "node"))
    picked = staged(thin.withColumn("nth", nth).filter(F.col("nth") <= g.audit_rows).drop("nth", "h"), "audit-sample")
    at = picked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = rows.join(sizes, "length").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    true = (blocks.groupBy("length", "block").cogroup(at.groupBy("length", "block"))
            .applyInPandas(count_true(g.threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")))
    found = links.groupBy("node").agg(F.sum("partners").alias("found"))
    of_vector = (true.filter(F.col("n") > 0).join(found, "node", "left").join(picked.select("node", "length"), "node")
                 .select("length", "n", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("found")))
    means = of_vector.groupBy("length", F.floor(F.log(4.0, F.col("n")) + 1e-9).alias("size")).agg(F.avg("found").alias("found"))
    return means.agg(F.coalesce(F.min("found"), F.lit(1.0))).first()[0]


def linked_vectors(rows: DataFrame, g: Graph = Graph()) -> tuple[DataFrame, DataFrame, float]:
    """(distinct vectors, links by shard, audited recall; 1.0 where all pairs were compared) of ``named`` rows."""
    distinct = staged(distinct_vectors(rows), "vectors")
    for overlap in range(g.overlap, max(g.overlap, g.max_overlap) + 1):
        links = find_links(distinct, shards(distinct, g, overlap), g)
        recall = audit(distinct, links, g)
        log.info("overlap %d: audited recall %.4f", overlap, recall)
        if recall >= g.min_recall:
            return distinct, links, recall
    log.warning("audited recall %.4f below %.4f: comparing all pairs", recall, g.min_recall)
    return distinct, every_pair(distinct, g), 1.0


def near_duplicates(vectors: DataFrame, g: Graph = Graph()) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row."""
    rows = named(vectors)
    distinct, links, recall = linked_vectors(rows, g)
    joined = connected(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    partners = links.groupBy("node").agg(F.sum("others").alias("others"))
    of_node = (distinct.select("node", "first_id", "copies").join(partners, "node", "left").join(joined, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    component = of_node.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = of_node.join(component, "root").select(
        "node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
                      F.lit(recall).alias("recall"))
