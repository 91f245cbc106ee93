"""Benchmark decontamination: short test items inside long documents.

Size-partitioned MinHash containment search.  Items are partitioned by their
number n of distinct shingles, class c holding 2^c <= n < 2^(c+1).  A document
that holds at least ``share`` of an item's shingles misses at most n - ceil(share n)
of them, so it holds one of any n - ceil(share n) + 1; the sketch of an item is that
many of its smallest hashes (a bottom-k MinHash whose length the class's largest n
sets).  Every document is searched for the sketch hashes of all classes in one pass
over its whole text, and every document with a hit is verified by exact shingle
containment.  No true pair is missed and no false one is left, whatever the lengths.

The benchmark is a stated query set: its sketches are sent to the tasks in blocks of
about ``block_items`` items and ``block_chars`` characters at most (further blocks are
further passes), and the documents are neither shuffled nor joined.

Words are split at the six ASCII spaces and A-Z lower-cased; a shingle is
``shingle`` consecutive words, and an item of fewer words is one shingle of all its
words, looked for at that length.

Cases: null or empty texts on either side match nothing; null ids are kept as they
are; repeated documents give repeated pairs, an item repeated with the same id and
text counts once; empty tables give no pairs.  In ``mark`` other columns pass
through and a column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import unused
from ledgerlens.llm.textarrays import Sequences, Words, parts, utf8

_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_shared", pa.int32())]))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], length: int) -> set[bytes]:
    return {b" ".join(words[i:i + length]) for i in range(len(words) - length + 1)}


def sketch_length(n: int, share: float) -> int:
    """Shingles of which a document with at least ``share`` of n must hold one."""
    return n - int(np.ceil(share * n - 1e-9)) + 1


class Sketches:
    """Sketches of a block of items, by shingle length and size class."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, share: float):
        self.share, self.items = share, []
        by_length: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = plain_words(text)
            if not words:
                continue
            length = min(shingle, len(words))
            self.items.append((item_id, length, shingle_set(words, length)))
            flat = np.frombuffer(b" ".join(words), dtype=np.uint8)
            grams = Sequences(Words(flat, np.array([0, len(flat)])).hashes()).windows(length)
            grams = np.unique(grams)
            size_class = len(grams).bit_length() - 1
            # the longest sketch that any size of this class needs
            k = min(len(grams), max(sketch_length(n, share) for n in range(2 ** size_class, 2 ** (size_class + 1))))
            by_length.setdefault(length, []).extend((int(h), len(self.items) - 1) for h in grams[:k])
        self.tables = {}
        for length, rows in by_length.items():
            rows.sort()
            hashes = np.array([h for h, _ in rows], dtype=np.uint64)
            coarse = np.zeros(1 << 20, dtype=bool)      # most hashes of a text end here
            coarse[hashes & np.uint64((1 << 20) - 1)] = True
            self.tables[length] = (coarse, hashes, np.array([i for _, i in rows]))

    def candidates(self, words: Words, n_rows: int) -> dict[int, set[int]]:
        """Row -> items of which the row's text holds a sketch hash."""
        out: dict[int, set[int]] = {}
        sums = Sequences(words.hashes())
        for length, (coarse, hashes, item) in self.tables.items():
            grams = sums.windows(length)
            row = words.row[:len(grams)]
            at = np.flatnonzero(coarse[grams & np.uint64((1 << 20) - 1)] & (row == words.row[length - 1:]))
            lo = np.searchsorted(hashes, grams[at], side="left")
            hi = np.searchsorted(hashes, grams[at], side="right")
            for a, i, j in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
                out.setdefault(int(row[a]), set()).update(item[i:j].tolist())
        return out

    def verified(self, text: str, found: set[int]) -> list[dict]:
        words, sets, out = plain_words(text), {}, []
        for i in sorted(found):
            item_id, length, shingles = self.items[i]
            if length not in sets:
                sets[length] = shingle_set(words, length)
            shared = len(shingles & sets[length])
            if shared >= self.share * len(shingles) - 1e-9:
                out.append({"item_id": item_id, "n_shingles": len(shingles), "n_shared": shared})
        return out


def marker(sketches, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sketches.value
        for batch in batches:
            for part in parts(batch):
                text = part.column("text")
                found = index.candidates(Words(*utf8(text), lower=True), part.num_rows)
                hits = [index.verified(text[r].as_py(), found[r]) if r in found else [] for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, _HIT)], names=[*part.schema.names, name])
    return run


def mark(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, share: float = 0.8,
         block_items: int = 20_000, block_chars: int = 16_000_000, name: str = "contaminated_by") -> DataFrame:
    """``docs`` with the array of items (item_id, n_shingles, n_shared) that each row's text holds."""
    spark = docs.sparkSession
    items = (benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
             .distinct())
    n_items, n_chars = items.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-n_items // block_items), -(-n_chars // block_chars))
    out = docs.drop(name)
    columns = unused([*out.columns, name], *[f"_hits{b}" for b in range(n_blocks)])
    for b, column in enumerate(columns):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        sketches = spark.sparkContext.broadcast(Sketches([tuple(r) for r in block.collect()], shingle, share))
        out = out.mapInArrow(marker(sketches, column), _schema(out, column))
    return out.withColumn(name, F.concat(*[F.col(c) for c in columns])).drop(*columns)


def _schema(df: DataFrame, column: str):
    from pyspark.sql import types as T
    hit = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shingles", T.IntegerType()),
                                    T.StructField("n_shared", T.IntegerType())]))
    return T.StructType([*df.schema.fields, T.StructField(column, hit)])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every pair at ``share`` or more."""
    out = mark(docs.select("doc_id", "text"), benchmark, shingle, share)
    return (out.select("doc_id", F.explode("contaminated_by").alias("hit")).select("doc_id", "hit.*")
            .withColumn("containment", F.col("n_shared") / F.col("n_shingles")))


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """The documents that hold no item."""
    name, = unused(docs.columns, "contaminated_by")
    return mark(docs, benchmark, shingle, share, name=name).filter(F.size(name) == 0).drop(name)
