"""SimHash near-dedup: 64-bit fingerprints linked by a binary trie self-join.

Fingerprint: A-Z lower-cased words, ``shingle``-word sequences (repeats included)
joined by one space, XXH64 with seed 42; a bit is set if it is set in over half
of the hashes.  Fewer words: the whole sequence; none: fingerprint zero.

Links: fingerprints at ``bits`` or fewer differing bits.  Equal fingerprints
collapse first, so copies cost one row.  Two fingerprints within three bits agree
on at least one of four 16-bit blocks, so the trie is cut into the subtries that
share a block: rows are dealt by (block, value), and inside each the trie is
joined with itself: pairs of nodes are walked down together bit by bit, the
differing bits add up, and a pair is dropped once they exceed the budget.  A
block value with very many fingerprints is cut once more, by the four 12-bit
blocks of the other 48 bits.  Each task passes on a spanning forest of the links
it found, so no group emits its square.  Components come from ``connected``.

Cases: null text is like empty text (fingerprint zero, linked like any other).
Null doc_id: fingerprint given, component null, linked with nothing.  Repeated
rows and ids: one result per row.  Empty table: no rows.  Only doc_id and text
are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import salted_rows, staged, text_hash
from ledgerlens.llm.components import connected

#: Fingerprints a task holds at about, and of one (block, value) before it is cut again.
TASK_ROWS = 60_000
#: Node pairs walked at once.
PAIRS = 1 << 20


def fingerprint_of(text: str | None, shingle: int, xxh) -> int:
    words = (text or "").encode().lower().split()          # bytes: only A-Z change, six spaces split
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = np.array([xxh(plain[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], dtype="<u8")
    n_set = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n_set += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * n_set > len(h), bitorder="little").view("<u8")[0])


def fingerprinter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        for batch in batches:
            prints = np.array([fingerprint_of(t.as_py(), shingle, xxh64_intdigest) for t in batch.column("text")],
                              dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))],
                                             names=["doc_id", "text_hash", "print"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, print) of every row, the fingerprint as a signed long."""
    return docs.select("doc_id", "text", text_hash()).mapInArrow(fingerprinter(shingle), "doc_id long, text_hash long, print long")


def trie_links(prints: np.ndarray, group: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of prints of the same group within ``budget`` bits.

    ``prints`` is sorted by (group, value).  A trie node is a range of it; a pair of
    nodes is (a0, a1, b0, b1, differing bits), at the depth that the stack entry names.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(starts[1:], len(prints))
    many = ends - starts > 1
    root = np.stack([starts, ends, starts, ends, np.zeros_like(starts)])[:, many]
    zeros: dict[int, np.ndarray] = {}
    stack = [(63, root)]
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > PAIRS:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
            continue
        a0, a1, b0, b1, diff = pairs
        area = (a1 - a0) * (b1 - b0)
        small = area <= 32
        if bit < 0:
            small[:] = True
        if small.any():          # few leaves below: compare them directly
            s = pairs[:, small]
            cells = area[small]
            for piece in np.array_split(np.arange(s.shape[1]), max(1, int(cells.sum()) // (4 * PAIRS) + 1)):
                n, width = cells[piece], (s[3] - s[2])[piece]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i = np.repeat(s[0][piece], n) + nth // np.repeat(width, n)
                j = np.repeat(s[2][piece], n) + nth % np.repeat(width, n)
                near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
                if near.any():
                    yield i[near], j[near]
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1) == 0)])
        z = zeros[bit]
        a0, a1, b0, b1, diff = pairs
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        down = np.concatenate([
            np.stack([a0, am, b0, bm, diff]), np.stack([am, a1, bm, b1, diff]),
            np.stack([a0, am, bm, b1, diff + 1]), np.stack([am, a1, b0, bm, diff + 1])], axis=1)
        a0, a1, b0, b1, diff = down
        # a node with itself goes down once; the lower range comes first
        live = (a1 > a0) & (b1 > b0) & (diff <= budget) & (a0 <= b0) & ~((a0 == b0) & (a1 - a0 < 2))
        if live.any():
            stack.append((bit - 1, down[:, live]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions."""
    low = np.arange(n)
    for i, j in links:
        while True:
            a, b = low[i], low[j]
            if (a == b).all():
                break
            np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := low[low], low):
                low = up
    return low


def join_bucket(budget: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        prints = rows["print"].to_numpy(np.int64).view(np.uint64)
        group = rows["cell"].to_numpy(np.int64)
        order = np.lexsort((prints, group))
        prints, group = prints[order], group[order]
        low = forest(len(prints), trie_links(prints, group, budget))
        own = low != np.arange(len(low))
        return pd.DataFrame({"a": prints[own].view(np.int64), "b": prints[low[own]].view(np.int64)})
    return run


def _blocks(value, width: int):
    return F.array(*[F.shiftrightunsigned(value, width * i).bitwiseAND((1 << width) - 1) for i in range(4)])


def print_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``print``) that keep every component
    of "differ in at most ``bits`` bits" together.  ``bits`` is 3 at most: four blocks."""
    if not 0 <= bits <= 3:
        raise ValueError("four blocks cover at most three differing bits")
    n = prints.count()
    cells = prints.select("print", F.posexplode(_blocks(F.col("print"), 16)).alias("block", "value"))
    heavy = (cells.groupBy("block", "value").count().filter(F.col("count") > TASK_ROWS)
             .select("block", "value", F.lit(True).alias("heavy")))
    cells = cells.join(heavy, ["block", "value"], "left")
    low_bits = F.expr("shiftleft(1L, 16 * block) - 1")
    rest = (F.expr("shiftleft(shiftrightunsigned(shiftrightunsigned(print, 16 * block), 16), 16 * block)")
            .bitwiseOR(F.col("print").bitwiseAND(low_bits)))
    sub = F.when(F.col("heavy"), F.transform(_blocks(rest, 12), lambda v, i: F.struct(i.alias("i"), v.alias("v")))) \
        .otherwise(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("v"))))
    cells = (cells.select("print", "block", "value", F.explode(sub).alias("s"))
             .select("print", F.xxhash64("block", "value", "s.i", "s.v").alias("cell")))
    n_buckets = salted_rows(4 * n, TASK_ROWS)
    return (cells.groupBy(F.pmod(F.xxhash64("cell"), F.lit(n_buckets)).alias("bucket"))
            .applyInPandas(join_bucket(bits), "a long, b long"))


def labelled_prints(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(print, root, first) of every distinct fingerprint of rows with an id; ``first`` is the smallest
    (doc_id, text_hash) of its rows, ``root`` names its component."""
    classes = staged(prints.filter(F.col("doc_id").isNotNull()).groupBy("print")
                     .agg(F.min(F.struct("doc_id", "text_hash")).alias("first")), "print-classes")
    nodes = connected(print_links(classes.select("print"), bits))
    return classes.join(nodes, classes["print"] == nodes["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = staged(fingerprints(docs, shingle), "prints")
    labelled = labelled_prints(prints, bits)
    roots = labelled.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    of_print = labelled.join(roots, "root").select(F.col("print").alias("_print"), "component_id")
    out = prints.join(of_print, prints["print"] == F.col("_print"), "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row of every component, with its smallest id and, where that id has several texts there, the
    smallest hash of the text; rows without an id stay.  Of rows equal in id and text, the one with the
    smallest hash of all columns stays."""
    prints = staged(fingerprints(docs, shingle), "prints")
    first = labelled_prints(prints, bits).groupBy("root").agg(F.min("first").alias("first"))
    keep = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    named = docs.filter(F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"),
                                                            F.xxhash64("text").alias("_hash"))
    kept = (named.join(keep, ["_id", "_hash"], "left_semi").groupBy("_id", "_hash")
            .agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*"))
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
