"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table (hash_a, hash_b, n_docs, keeper) sorted by hash; the
runs live in levels below one folder.  Batches of documents come in descending
order of id.  A new batch reduces its lines to one row per hash, merge-anti-joins
the hashes that the runs already hold in ``enough`` documents (nothing about them
can change: their keeper has the larger id), and adds what is left as its own run
at level 0; once ``fan_out`` runs stand on a level they are merged into one run of
the next level.  Counts and keepers add up over the runs.

``drop_repeats`` then removes from each document the lines whose key stands in
at least ``min_docs`` documents, except in the largest doc_id that holds it.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased; keys shorter than ``min_chars`` code points are never dropped.
Hashes are two independent 64-bit hashes of the key (128 bits).

Cases: null or empty text: one empty line, nothing dropped.  Null doc_id: the
row is neither counted nor changed.  Repeated rows or repeated ids: one id
counts as one document, and every row of the keeping id keeps its lines.  Empty
table: no runs, no rows.  Other columns pass through; columns named like the
results (n_lines, n_dropped, kept_text) are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACES, lower_ascii, stage_path, staged, unused

RUN_SCHEMA = "hash_a long, hash_b long, n_docs long, keeper long"
HASH = ["hash_a", "hash_b"]


def line_key(line):
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def lines(docs: DataFrame, text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, line_no, hash_a, hash_b) of every line with a key of ``min_chars`` or more."""
    keyed = (docs.filter(F.col("doc_id").isNotNull())
             .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines(docs)).alias("line_no", "line"))
             .withColumn("key", line_key(F.col("line")))
             .filter(F.char_length("key") >= min_chars))
    return keyed.select("doc_id", "text_hash", "line_no", F.xxhash64("key").alias("hash_a"),
                        F.xxhash64(F.lit("line"), F.reverse("key")).alias("hash_b"))


@dataclass
class LineRuns:
    """The levelled runs below ``folder`` (in the shared checkpoint folder unless given)."""
    spark: SparkSession
    enough: int = 5
    folder: str = ""
    fan_out: int = 2
    levels: dict[int, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.folder = self.folder or stage_path(self.spark, "line-runs")

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/level={level}/{uuid.uuid4().hex}"
        run.sortWithinPartitions(*HASH).write.parquet(path)
        self.levels.setdefault(level, []).append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], RUN_SCHEMA) if not paths else None
        for p in paths:
            part = self.spark.read.schema(RUN_SCHEMA).parquet(p)
            out = part if out is None else out.unionByName(part)
        return out

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def table(self) -> DataFrame:
        """One row per hash over all runs."""
        return self._merged([p for level in sorted(self.levels) for p in self.levels[level]])

    def add(self, batch: DataFrame) -> None:
        """Add a batch of line hashes with ids below all ids of the batches before."""
        own = (batch.select("doc_id", *HASH).distinct()
               .groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")))
        if self.levels:
            settled = self.table().filter(F.col("n_docs") >= self.enough).select(*HASH)
            own = own.join(settled.hint("merge"), HASH, "left_anti")
        self._write(own, 0)
        level = 0
        while len(self.levels.get(level, [])) >= self.fan_out:
            paths, self.levels[level] = self.levels[level], []
            self._write(self._merged(paths), level + 1)
            level += 1


def descending_batches(hashes: DataFrame, n_batches: int) -> list:
    """Conditions that split doc_id into ranges of about equal size, largest ids first."""
    cuts = hashes.agg(F.percentile_approx("doc_id", [i / n_batches for i in range(1, n_batches)], 1000)
                      .alias("cuts")).first()["cuts"] if n_batches > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    doc = F.col("doc_id")
    if not cuts:
        return [doc.isNotNull()]
    return ([doc > cuts[0]] + [(doc <= hi) & (doc > lo) for hi, lo in zip(cuts, cuts[1:])] + [doc <= cuts[-1]])


def drop_repeats(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, n_batches: int = 4,
                 fan_out: int = 2, names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """Documents with ``kept_text, n_lines, n_dropped`` (or other ``names``; columns of these names give way)."""
    docs = docs.drop(*names)
    own_id, own_hash, gone, every, cut = unused([*docs.columns, *names], "_id", "_hash", "_dropped", "_lines", "_cuts")
    # written once: every batch and the last join read it instead of splitting the texts again
    hashes = staged(line_hashes(docs, min_chars), "line-hashes")
    runs = LineRuns(docs.sparkSession, enough=min_docs, fan_out=fan_out)
    for batch in descending_batches(hashes, n_batches):
        runs.add(hashes.filter(batch))
    # a table of its own, so that the join below stands between two exchanges and a very common line can be split
    repeated = staged(runs.table().filter(F.col("n_docs") >= min_docs).select(*HASH, "keeper"), "repeated-lines")
    dropped = (hashes.join(repeated, HASH).filter(F.col("doc_id") != F.col("keeper"))
               .groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
               .agg(F.sort_array(F.collect_set("line_no")).alias(gone)))
    out = docs.join(dropped, (F.col("doc_id") == F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash)), "left")
    out = out.withColumn(every, lines(out))
    out = out.withColumn(cut, F.concat(F.array(F.lit(-1)), gone, F.array(F.size(every))))
    # the kept lines are the slices between two dropped ones
    kept = F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(cut) - 1),
        lambda j: F.slice(every, F.get(cut, j - 1) + 2, F.get(cut, j) - F.get(cut, j - 1) - 1)))
    text, n_lines, n_dropped = names
    return (out.withColumn(n_lines, F.size(every).cast("long"))
            .withColumn(n_dropped, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
            .withColumn(text, F.when(F.col(gone).isNull(), F.coalesce(F.col("text"), F.lit("")))
                        .otherwise(F.array_join(kept, "\n")))
            .drop(own_id, own_hash, gone, every, cut))
