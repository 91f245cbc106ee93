"""Phrase collocations by best-first branch and bound over prefix counts.

A candidate is a phrase of 2 to 4 words with at least ``least`` occurrences in its language; its
score is floor(scale * a / (l + r)) at the cut of its words that scores lowest.  A candidate
goes if a longer one that holds its words has nearly as many occurrences.  Wanted are the
``limit`` best survivors of every language.

1. Words and pairs are counted once by 64-bit keys; a bit table of fixed size (``filter_bits``)
   of the keys that are frequent enough lets a second scan count those by their text, so
   rare pairs never travel as text.  (A full table only lets more of them through.)
2. Bound: an extension of a prefix p that starts with the word w occurs a <= f(p) times, and its
   cut after w has r >= a, so neither p nor any extension scores above
   floor(scale * f(p) / (f(w) + f(p))).
3. The frontier is the prefixes (2 and 3 words) not expanded yet.  A round expands the best of
   it, at most ``round_prefixes`` at once: one scan counts everything that extends them by a
   word to the right and, if they may be wanted themselves, to the left (a longer candidate on
   either side may replace them), unless the bit table shows that a pair in it is rare.  The first
   round takes the pairs that score best themselves; from the survivors whose extensions are
   known comes each language's ``limit``-th score, and every later round takes prefixes
   whose bound reaches it.  When none is left, no open phrase can reach that score, nor tie with it.

Counts are grouped by the phrase itself (keys only choose what is counted); scores use decimals.
Only a round's keys, at most ``round_prefixes`` longs and the suffix pairs of its triples, and the
bit table pass through the driver.

Cases: null texts are empty; null languages are ``und``; empty and very long texts, texts without
words and repeated rows are counted as they are (a repeated row counts twice); an empty table gives
no rows.  Only lang and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged
from ledgerlens.llm.textarrays import Sequences, Words, lowered, mix64, parts, signed, utf8

_U = np.uint64
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = _BREAK


@dataclass(frozen=True)
class Mining:
    least: int = 30
    longest: int = 4
    limit: int = 2000
    scale: int = 2_000_000
    absorbed: int = 80              # per cent of its occurrences inside one longer candidate
    round_prefixes: int = 200_000
    filter_bits: int = 27           # the bit table has 2^27 bits, 16 MB
    part_bytes: int = 512 << 10
    salts: int = 64                 # parts of a language where its best are looked for


# ---------------------------------------------------------------- one batch of texts

class Phrases:
    """Words of a batch of texts; a phrase is a run of words within one piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, at = utf8(batch.column(1))
        self.data = lowered(data)
        kind = _KIND[self.data]
        words = Words(self.data, at, inside=kind == 0)
        self.start, self.size = words.start, words.end - words.start
        self.piece = np.cumsum(kind == _BREAK)[words.start] + words.row if len(words) else np.zeros(0, dtype=np.int64)
        self.words = Sequences(words.hashes()) if len(words) else Sequences(np.zeros(0, dtype=_U))
        langs = batch.column(0).fill_null("und").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy()[words.row]
        salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs.to_pylist()], dtype=_U)
        self.salt = salt[self.lang]

    def __len__(self) -> int:
        return len(self.start)

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of the phrase of ``n`` words at each word, and whether it stays within a piece."""
        k = max(0, len(self) - n + 1)
        return mix64(self.words.windows(n) ^ self.salt[:k]), self.piece[n - 1:n - 1 + k] == self.piece[:k]

    def texts(self, first: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words that start at the words ``first``, joined by one space."""
        at = first[:, None] + np.arange(n)
        size = self.size[at] + (np.arange(n) < n - 1)
        ends = np.cumsum(size.ravel())
        begins = ends - size.ravel()
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.start[at].ravel() - begins, size.ravel())
        out = self.data[np.minimum(source, max(len(self.data) - 1, 0))]
        out[ends.reshape(at.shape)[:, :-1].ravel() - 1] = 32
        offsets = np.concatenate([[0], ends.reshape(at.shape)[:, -1]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))

    def counted(self, keys: np.ndarray, at: np.ndarray, n: int):
        """Batches of (lang, n, phrase, key, f) of the phrases with these keys at the words ``at``."""
        key, first, f = np.unique(keys, return_index=True, return_counts=True)
        for s in range(0, len(key), 1 << 17):
            some = at[first[s:s + (1 << 17)]]
            yield _batch(self.langs.take(pa.array(self.lang[some])), n, self.texts(some, n), key[s:s + (1 << 17)], f[s:s + (1 << 17)])


def _batch(lang: pa.Array, n: int, phrase: pa.Array, key: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(key), n, dtype=np.int32)), phrase, pa.array(signed(key)),
                                       pa.array(f.astype(np.int64))], names=["lang", "n", "phrase", "key", "f"])


COUNTS = "lang string, n int, phrase string, key long, f long"


def combined(batches, rows: int = 150_000):
    """Batches of counts with the counts of equal keys of about ``rows`` rows put together; what Arrow
    keeps of the rows put together before is given back, as a task's memory counts with all others'."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from _combined(held)
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if n:
        yield from _combined(held)


def _combined(held: list[pa.RecordBatch]):
    table = pa.Table.from_batches(held)
    _, first, of = np.unique(table["key"].to_numpy(), return_index=True, return_inverse=True)
    f = np.bincount(of, weights=table["f"].to_numpy()).astype(np.int64)
    table = table.take(pa.array(first)).set_column(4, "f", pa.array(f))
    yield from table.combine_chunks().to_batches(max_chunksize=1 << 17)


def key_counts(m: Mining, rows: int = 500_000):
    """(key, f) of words and pairs."""
    def sums(held):
        key, f = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(f.astype(np.int64))], names=["key", "f"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in parts(batch, most=m.part_bytes):
                p = Phrases(part)
                held += [k[ok] for k, ok in (p.keys(1), p.keys(2))]
                n += 2 * len(p)
                if n >= rows:
                    yield sums(held)
                    held, n = [], 0
        if n:
            yield sums(held)
    return run


def frequent_counts(m: Mining, table):
    """Counts of the words and pairs whose bit is set, and as phrase of no words the number of a language's words."""
    def found(batches):
        words = table.value
        for batch in batches:
            for part in parts(batch, most=m.part_bytes):
                p = Phrases(part)
                if not len(p):
                    continue
                lang, f = np.unique(p.lang, return_counts=True)
                salt = np.zeros(len(p.langs), dtype=_U)
                salt[p.lang] = p.salt
                yield _batch(p.langs.take(pa.array(lang)), 0, pa.array([""] * len(lang)), salt[lang], f)
                for n in (1, 2):
                    keys, ok = p.keys(n)
                    at = np.flatnonzero(ok & _often(keys, words, m))
                    yield from p.counted(keys[at], at, n)
    return lambda batches: combined(found(batches))


def _often(keys: np.ndarray, table: np.ndarray, m: Mining) -> np.ndarray:
    """Which of ``keys`` have their bit set: all words and pairs with ``least`` occurrences, and few others."""
    bit = keys >> _U(64 - m.filter_bits)
    return table[bit >> _U(6)] >> (bit & _U(63)) & _U(1) == 1


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(keys), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def extension_counts(m: Mining, wanted, table):
    """Counts of the phrases that extend a wanted one by a word to the right or, where both sides are wanted, to the
    left; ``wanted`` has sorted keys by (number of words, side).

    A phrase occurs no more often than any pair in it, so those with a pair whose bit is not set are left out: they
    cannot have ``least`` occurrences."""
    def found(batches):
        for batch in batches:
            for part in parts(batch, most=m.part_bytes):
                p = Phrases(part)
                pairs = _often(p.keys(2)[0], table.value, m)
                for n in range(2, m.longest):
                    keys, _ = p.keys(n)
                    longer, ok = p.keys(n + 1)
                    if len(longer):
                        at = np.flatnonzero(ok & np.logical_and.reduce([pairs[i:i + len(longer)] for i in range(n)]))
                        at = at[_among(keys[at], wanted.value[n, "right"]) | _among(keys[at + 1], wanted.value[n, "left"])]
                        yield from p.counted(longer[at], at, n + 1)
    return lambda batches: combined(found(batches))


# ---------------------------------------------------------------- counts

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def _summed(found: DataFrame, least: int) -> DataFrame:
    return (found.groupBy("lang", "n", "phrase", "key").agg(F.sum("f").alias("f"))
            .filter((F.col("f") >= least) | (F.col("n") == 0)))


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for the first ``bits`` bits of every key, in 64-bit words that Spark puts together (2^bits / 64 at most)."""
    bit = F.shiftrightunsigned("key", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    rows = keys.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(one).alias("word")).toPandas()
    out = np.zeros(max(1, (1 << bits) >> 6), dtype=np.int64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["word"].to_numpy(dtype=np.int64)
    return out.view(_U)


def first_counts(docs: DataFrame, m: Mining):
    """(words and pairs with at least ``least`` occurrences and every language's number of words (n = 0), the bit table
    of their keys for all tasks)."""
    sums = _texts(docs).mapInArrow(key_counts(m), "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
    often = staged(sums.filter(F.col("f") >= m.least).select("key"), "frequent-keys")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(often, m.filter_bits))
    return staged(_summed(_texts(docs).mapInArrow(frequent_counts(m, table), COUNTS), m.least), "phrase-counts"), table


# ---------------------------------------------------------------- scores and bounds

def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _ratio(m: Mining, a: Column, whole: Column) -> Column:
    """floor(scale * a / whole), exactly."""
    return F.call_function("div", F.lit(m.scale).cast("decimal(10,0)") * _exact(a), whole)


def _words(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, n), " ")


def scored(counts: DataFrame, phrases: DataFrame, m: Mining) -> DataFrame:
    """``phrases`` with l, r and score of their lowest-scoring cut; those with a part not counted yet are left out."""
    known = counts.filter(F.col("n") > 0).select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.withColumn("part", _words(F.col("phrase"), F.lit(1), F.col("k")))
    cuts = cuts.join(known, ["lang", "part"]).withColumnRenamed("part_f", "l")
    cuts = cuts.withColumn("part", _words(F.col("phrase"), F.col("k") + 1, F.col("n") - F.col("k")))
    cuts = cuts.join(known, ["lang", "part"]).withColumnRenamed("part_f", "r")
    cuts = cuts.withColumn("score", _ratio(m, F.col("f"), _exact(F.col("l")) + _exact(F.col("r"))))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    out = cuts.groupBy("lang", "n", "phrase", "key", "f").agg(lowest, F.count("*").alias("cuts"))
    return out.filter(F.col("cuts") == F.col("n") - 1).select("lang", "n", "phrase", "key", "f", "cut.score", "cut.l", "cut.r")


def bounds(counts: DataFrame, prefixes: DataFrame, m: Mining) -> DataFrame:
    """Scored prefixes with the ``bound`` of their own and all their extensions' scores."""
    word = counts.filter(F.col("n") == 1).select("lang", F.col("phrase").alias("word"), F.col("f").alias("word_f"))
    bound = _ratio(m, F.col("f"), _exact(F.col("word_f")) + _exact(F.col("f")))
    some = prefixes.filter(F.col("n") < m.longest).withColumn("word", F.substring_index("phrase", " ", 1))
    return some.join(word, ["lang", "word"]).select("lang", "n", "phrase", "key", "score", bound.alias("bound"))


def _best(rows: DataFrame, k: int, m: Mining, *order: Column) -> DataFrame:
    """The first ``k`` rows of every language with their ``rank``; a large language is gone through in salted parts first."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(m.salts))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= k)


def best_first() -> tuple[Column, ...]:
    return F.desc("score"), F.desc("f"), F.asc("phrase")


def survivors(counts: DataFrame, scores: DataFrame, expanded: DataFrame, m: Mining) -> DataFrame:
    """Scored candidates whose extensions are known and none of which holds ``absorbed`` per cent of their occurrences."""
    longer = counts.filter(F.col("n") > 2).select("lang", "n", "phrase", F.col("f").alias("longer_f"))
    inside = F.explode(F.array(_words(F.col("phrase"), F.lit(1), F.col("n") - 1), _words(F.col("phrase"), F.lit(2), F.col("n") - 1)))
    longer = longer.select("lang", inside.alias("phrase"), "longer_f").groupBy("lang", "phrase").agg(F.max("longer_f").alias("longer_f"))
    known = expanded.filter("both").select("lang", "phrase").distinct()
    settled = (scores.filter(F.col("n") < m.longest).join(known, ["lang", "phrase"], "left_semi")
               .unionByName(scores.filter(F.col("n") == m.longest)))
    gone = 100 * _exact(F.col("longer_f")) >= m.absorbed * _exact(F.col("f"))
    return settled.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(gone, F.lit(False))).drop("longer_f")


def _round(frontier: DataFrame, counts: DataFrame, m: Mining) -> DataFrame:
    """The prefixes of a round (lang, n, phrase, key, both); a triple brings the pair of its last two words, whose
    extensions to the right are what its own are cut into."""
    own = ("lang", "n", "phrase", "key", "both")
    take = staged(frontier.orderBy(F.desc("priority"), "lang", "phrase").limit(m.round_prefixes).select(*own), "round")
    inner = (take.filter(F.col("n") > 2).select("lang", _words(F.col("phrase"), F.lit(2), F.col("n") - 1).alias("phrase")).distinct()
             .join(counts.filter(F.col("n") == 2).select("lang", "n", "phrase", "key"), ["lang", "phrase"]))
    both = take.unionByName(inner.withColumn("both", F.lit(False)).select(*own))
    return staged(both.groupBy("lang", "n", "phrase", "key").agg(F.max("both").alias("both")), "round")


def _extended(docs: DataFrame, chosen: DataFrame, table, m: Mining) -> DataFrame:
    keys = chosen.select("n", "key", "both").toPandas()
    sides = {"right": np.ones(len(keys), dtype=bool), "left": keys["both"].to_numpy(dtype=bool)}
    wanted = {(n, side): np.sort(np.unique(keys["key"][(keys["n"] == n) & mask].to_numpy(dtype=np.int64)).view(_U))
              for n in range(2, m.longest) for side, mask in sides.items()}
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    return _summed(_texts(docs).mapInArrow(extension_counts(m, shared, table), COUNTS), m.least)


def collocations(docs: DataFrame, m: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``limit`` survivors of every language."""
    spark: SparkSession = docs.sparkSession
    counts, table = first_counts(docs, m)
    pairs = staged(scored(counts, counts.filter(F.col("n") == 2), m), "pair-scores")
    scores, expanded = pairs, spark.createDataFrame([], "lang string, phrase string, both boolean")
    frontier = _best(pairs, 2 * m.limit, m, *best_first()).withColumns({"priority": F.col("score"), "both": F.lit(True)})
    while True:
        chosen = _round(frontier, counts, m)
        if chosen.isEmpty():
            break
        expanded = staged(expanded.unionByName(chosen.select("lang", "phrase", "both")), "expanded")
        counts = staged(counts.unionByName(_extended(docs, chosen, table, m)).dropDuplicates(["lang", "n", "phrase"]), "phrase-counts")
        scores = pairs.unionByName(staged(scored(counts, counts.filter(F.col("n") > 2), m), "scores"))
        best = staged(_best(survivors(counts, scores, expanded, m), m.limit, m, *best_first()), "best")
        reach = (best.filter(F.col("rank") == m.limit).select("lang", F.col("score").alias("reach"))
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(m.salts - 1)))))
        # the reach only rises, so a prefix that scores below it is never wanted itself: its right side is enough
        salt = F.pmod(F.xxhash64("phrase"), F.lit(m.salts)).cast("int")
        open_ = bounds(counts, scores, m).withColumn("salt", salt).join(reach, ["lang", "salt"], "left")
        open_ = open_.withColumn("both", F.col("score") >= F.coalesce("reach", F.lit(-1)))
        done = expanded.groupBy("lang", "phrase").agg(F.max("both").alias("was"))
        frontier = (open_.filter(F.col("bound") >= F.coalesce("reach", F.lit(-1))).join(done, ["lang", "phrase"], "left")
                    .filter(F.col("was").isNull() | (F.col("both") & ~F.col("was"))).withColumn("priority", F.col("bound")))
    if scores is pairs:             # no pair occurs often enough
        best = _best(pairs, m.limit, m, *best_first())
    words = counts.filter(F.col("n") == 0).select("lang", F.col("f").alias("words"))
    return (best.join(words, "lang")
            .select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", F.col("words").alias("n"), "score"))
