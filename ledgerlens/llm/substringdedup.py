"""Substring dedup by seed and extend over winnowed anchors.

A window is ``window`` consecutive words of one document.  Its anchor is the
smallest hash among its ``gram``-word sequences: a property of the window's words
alone, so equal windows have equal anchors wherever they stand (winnowing, which
keeps about two anchors per ``window - gram`` words).  A seed is a maximal run of
windows of one document with the same anchor.

1. ``seeds``: one pass over the texts; per seed its anchor, the hash of all its
   words, first window and number of windows.
2. Seeds are joined on the anchor by aggregates, never as pairs: seeds with the
   same words collapse into one (thousands of copies become one row), anchors
   of a single document go.
3. A seed is a repeat as it stands in every document after its first.  Where an
   anchor's seeds differ (at the edges of a repeat) the seed is extended both ways
   window by window: the windows of one representative per distinct seed are hashed,
   a second aggregate finds the smallest document of every window, and those that
   begin before the seed's own first document are repeats there too.
4. Windows that also start in a document with a smaller id mark their words; runs
   of marked words are the maximal repeats of ``window`` words or more.

Two independent 64-bit hashes (anchor, and seed or window) identify a window.

Cases: null or short texts lose nothing.  Null doc_id: the row neither loses
words nor takes them from others.  Repeated rows and ids: windows are compared
between different ids only; every row keeps its own count.  Empty table: no rows.
Only doc_id and text are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged, text_hash
from ledgerlens.llm.textarrays import Sequences, Words, mix64, parts, signed, sliding_min, utf8

#: Windows of a seed at most (a longer run with one anchor is several seeds).
SEED_WINDOWS = 64

SEED_SCHEMA = "doc_id long, text_hash long, start int, n int, anchor long, words long"


def _prefixes(words: Words) -> tuple[Sequences, Sequences]:
    """Two independent sequence hashes over the same words."""
    h = words.hashes()
    return Sequences(h), Sequences(mix64(h ^ np.uint64(0xD6E8FEB86659FD93)))


def find_seeds(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                w = Words(*utf8(part.column("text")))
                if len(w) < window:
                    continue
                grams, spans = _prefixes(w)
                anchor = sliding_min(grams.windows(gram), window - gram + 1)
                n = len(anchor)
                valid = w.row[:n] == w.row[window - 1:window - 1 + n]
                fresh = valid.copy()
                fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (w.row[1:n] != w.row[:n - 1])
                begin = np.flatnonzero(fresh)
                if not len(begin):
                    continue
                # a run ends before the next one, or where windows stop being valid
                stops = np.flatnonzero(valid & ~np.append(valid[1:] & ~fresh[1:], False)) + 1
                length = stops - begin
                pieces = -(-length // SEED_WINDOWS)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.repeat(begin, pieces) + nth * SEED_WINDOWS
                count = np.minimum(np.repeat(length, pieces) - nth * SEED_WINDOWS, SEED_WINDOWS)
                row = w.row[start]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(row)), part.column("text_hash").take(pa.array(row)),
                    pa.array((start - w.first[row]).astype(np.int32)), pa.array(count.astype(np.int32)),
                    pa.array(signed(anchor[start])), pa.array(signed(spans.spans(start, start + count + window - 1)))],
                    names=["doc_id", "text_hash", "start", "n", "anchor", "words"])
    return run


def hash_windows(window: int):
    """Rows with text and ``seeds`` (anchor, words, start, n) -> one row per window of the seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                w = Words(*utf8(part.column("text")))
                _, spans = _prefixes(w)
                lists = part.column("seeds")
                per_row = np.diff(lists.offsets.to_numpy())
                seeds = lists.flatten()
                get = lambda name: seeds.field(name).to_numpy(zero_copy_only=False)
                n = get("n").astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), per_row)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(w.first[row] + get("start"), n) + off
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(get("anchor"), n)), pa.array(np.repeat(get("words"), n)),
                    pa.array(off.astype(np.int32)), pa.array(signed(spans.spans(start, start + window))),
                    part.column("doc_id").take(pa.array(np.repeat(row, n)))],
                    names=["anchor", "words", "off", "win", "doc_id"])
    return run


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with text and ``repeats`` (from, to) -> counts, kept text and the merged spans."""
    for batch in batches:
        for part in parts(batch):
            ids, n_words, n_removed, kept, removed = part.column("doc_id"), [], [], [], []
            for text, spans in zip(part.column("text"), part.column("repeats")):
                words = (text.as_py() or "").encode().split()      # bytes split on the six ASCII spaces
                n_words.append(len(words))
                merged: list[dict] = []
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    flat = spans.values
                    np.add.at(edge, flat.field("from").to_numpy(), 1)
                    np.add.at(edge, flat.field("to").to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    merged = [{"from": int(a), "to": int(b)} for a, b in zip(turn[::2], turn[1::2])]
                    words = [w for w, g in zip(words, gone) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
                removed.append(merged)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                pa.array(removed, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])


def repeated_spans(docs: DataFrame, window: int = 50, gram: int = 10) -> DataFrame:
    """(doc_id, text_hash, repeats): word spans that also stand in a smaller doc_id."""
    keyed = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", text_hash(), "text")
    seeds = staged(keyed.mapInArrow(find_seeds(window, gram), SEED_SCHEMA), "seeds")

    distinct = (seeds.groupBy("anchor", "words")
                .agg(F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("rep"),
                     F.max("doc_id").alias("last")))
    anchors = (distinct.groupBy("anchor").agg(F.min("rep.doc_id").alias("anchor_first"),
                                              F.max("last").alias("anchor_last"), F.count("*").alias("n_forms"))
               .filter(F.col("anchor_first") < F.col("anchor_last")))
    shared = staged(distinct.join(anchors, "anchor"), "shared-seeds")

    differ = shared.filter((F.col("n_forms") > 1))
    by_doc = (differ.groupBy("rep.doc_id", "rep.text_hash")
              .agg(F.collect_list(F.struct("anchor", "words", "rep.start", "rep.n")).alias("seeds")))
    windows = (keyed.join(by_doc, ["doc_id", "text_hash"]).select("doc_id", "text", "seeds")
               .mapInArrow(hash_windows(window), "anchor long, words long, off int, win long, doc_id long"))
    windows = staged(windows, "windows")
    first = (windows.groupBy("anchor", "win").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .filter(F.col("first") < F.col("last")).drop("last"))
    # windows of a distinct seed that also stand in a document before the seed's own first one
    before = (windows.join(first, ["anchor", "win"]).filter(F.col("first") < F.col("doc_id"))
              .groupBy("anchor", "words").agg(F.collect_set("off").alias("offs")))
    # in documents after the seed's first one all of its windows are repeats, in the first one those
    marks = (shared.filter(F.col("n_forms") > 1).select("anchor", "words", F.col("rep.doc_id").alias("own"), "last")
             .join(before, ["anchor", "words"], "left")
             .unionByName(shared.filter(F.col("n_forms") == 1).select(
                 "anchor", "words", F.col("rep.doc_id").alias("own"), "last", F.lit(None).cast("array<int>").alias("offs")))
             .filter((F.col("own") < F.col("last")) | F.col("offs").isNotNull()).drop("last"))
    hits = seeds.join(marks, ["anchor", "words"]).filter((F.col("doc_id") > F.col("own")) | F.col("offs").isNotNull())
    one = F.array(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("n") + window - 1).alias("to")))
    some = F.transform("offs", lambda o: F.struct((F.col("start") + o).alias("from"), (F.col("start") + o + window).alias("to")))
    return (hits.select("doc_id", "text_hash", F.when(F.col("doc_id") > F.col("own"), one).otherwise(some).alias("s"))
            .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("s")).alias("repeats")))


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 10) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) of every row."""
    spans = repeated_spans(docs, window, gram)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "repeats")
    out = rows.join(spans, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    return out.select("doc_id", "text", "repeats").mapInArrow(
        cut_words, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<from:int,to:int>>")
