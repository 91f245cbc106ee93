"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a target (words the mix takes from it) and a weight schedule
over training time t in [0, 1], ``w(t) = target * (1 + slope * (2 t - 1))``,
whose integral is the target.  The cumulative token demand is the integral
``W(t) = target * ((1 - slope) * t + slope * t^2)``; a copy of a document that starts
at cumulative offset c of its source's repeated stream is wanted at ``W^-1(c)``.
``positions`` holds one such position for each copy that the mix takes, so the
demand of a source is served all along, also in its second round; ``position``,
the first of them, orders the documents by a range sort, and ``training_order``
orders the copies.

Targets: demand = ``demand_ratio`` x all sizes, shared by weight; a source stops
at ``max_repeat`` x its size and the excess is shared again by weight until no
source is above (the water level of the weights).  Both are exact integer sums
up to one division, so reruns and other engines agree.

A source's stream is its documents in a fixed pseudo-random order (md5 of the
id), repeated; the mix takes the stream's first ``round(target)`` words, so each
document is taken whole a number of times, and one document per source in part.

Cases: null text, or text of white space only: size 0, nothing taken.  Null
source: a source of its own, last in order.  Repeated rows and repeated or null
ids: every row is a document; ties are broken by size and text hash.  Empty
table: no rows.  Other columns pass through; names that clash with the results
(size, source_size, target, taken, position, positions, epochs) are replaced by the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import n_words, unused


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order, repeating; slopes likewise."""
    weights: tuple[int, ...] = (5, 2, 1)
    slopes: tuple[float, ...] = (-0.5, 0.0, 0.5)
    demand_ratio_pct: int = 150
    max_repeat: int = 2
    order_digits: int = 3          # hex digits of the order key that make a bucket (16^n buckets)


RESULTS = ("size", "source_size", "target", "taken", "position", "positions", "epochs")


def source_targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: source_size, weight, slope, target.

    The windows below run over one row per source (never over documents).
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]),
                                       ((F.row_number().over(in_order) - 1) % len(values) + 1).cast("int"))
    src = by_source.select("source", "source_size", pick(mix.weights).cast("long").alias("weight"),
                           pick([float(s) for s in mix.slopes]).alias("slope"))
    src = src.withColumn("cap", F.col("source_size") * mix.max_repeat)
    # sources in the order in which a rising level fills them
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    src = (src.withColumn("demand", F.sum("source_size").over(everything) * mix.demand_ratio_pct)   # x 100
           .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("weight_left", F.sum("weight").over(everything)
                       - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the level if exactly the sources before this one are full; it holds where it does not overfill this one
    rest = F.col("demand") - F.col("cap_before") * 100
    holds = rest.cast("double") * F.col("weight") <= F.col("cap") * 100.0 * F.col("weight_left")
    level = F.first(F.when(holds, F.struct(rest.alias("rest"), F.col("weight_left").alias("over"))),
                    ignorenulls=True).over(everything)
    src = src.withColumn("level", level)
    share = F.col("level.rest") * F.col("weight") / (F.lit(100.0) * F.col("level.over"))
    # a level always exists below demand_ratio = max_repeat; beyond it every source is full
    return src.select("source", "source_size", "slope",
                      F.coalesce(F.least(share, F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Documents with ``size, source_size, target, taken, epochs, position, positions``,
    range-sorted by position (rows that take nothing come last; their positions are empty)."""
    sized = docs.drop(*[c for c in RESULTS if c in docs.columns])
    sized = sized.withColumn("size", n_words(F.col("text")))
    src = source_targets(sized, mix)

    # names of this function's own, whatever the table's columns are called
    key_, bucket, own, at, ahead_, inside_, slope = unused(
        [*sized.columns, *RESULTS], "_key", "_bucket", "_source", "_b", "_ahead", "_inside", "_slope")
    rows = (sized.withColumn(key_, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
            .withColumn(bucket, F.substring(key_, 1, mix.order_digits)))
    # prefix sums: inside a (source, bucket) by a window, across buckets by one row per bucket
    per_bucket = rows.groupBy("source", bucket).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("source", F.col(bucket).alias(at), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias(ahead_))
    offsets = (per_bucket.join(src, per_bucket["source"].eqNullSafe(src["source"]))
               .select(per_bucket["source"].alias(own), at, ahead_, "source_size", "target", F.col("slope").alias(slope)))
    inside = (Window.partitionBy("source", bucket).orderBy(key_, "size", F.xxhash64("text"))
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(inside_, F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = rows.join(offsets, rows["source"].eqNullSafe(offsets[own]) & (F.col(bucket) == F.col(at)))

    size, total = F.col("size"), F.col("source_size")
    start = F.col(ahead_) + F.col(inside_)
    # the mix takes words 0 .. wanted of the repeated stream; this document is at
    # start .. start + size of every round
    wanted = F.round("target").cast("long")
    rounds = F.when(total > 0, F.floor(wanted / total)).otherwise(0).cast("long")
    rest = wanted - rounds * total
    part = F.greatest(F.lit(0), F.least(size, rest - start))
    taken = (rounds * size + part).cast("long")
    out = out.withColumn("taken", taken)
    # one copy for each whole round, and one for the round that is taken in part; a source is taken at most
    # max_repeat times, so these are few
    copies = F.when(F.col("taken") > 0, rounds + (part > 0).cast("long")).otherwise(F.lit(0))
    line = 1.0 - F.col(slope)

    def wanted_at(offset):
        """W(t) = offset solved for t: slope t^2 + (1 - slope) t - offset / target = 0."""
        u = F.when(F.col("target") > 0, F.least(F.lit(1.0), offset / F.col("target"))).otherwise(0.0)
        return F.round(F.when(F.col(slope) == 0, u).otherwise(
            (F.sqrt(line * line + 4.0 * F.col(slope) * u) - line) / (2.0 * F.col(slope))), 9)
    every = F.filter(F.sequence(F.lit(0), F.lit(mix.max_repeat)), lambda k: k < copies)
    out = (out.withColumn("epochs", F.when(size > 0, F.col("taken") / size).otherwise(0.0))
           .withColumn("positions", F.transform(every, lambda k: wanted_at(k * total + start)))
           .withColumn("position", F.get("positions", F.lit(0)))
           .drop(key_, bucket, own, at, ahead_, inside_, slope))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(mixed: DataFrame) -> DataFrame:
    """The copies that the mix takes, range-sorted by their positions: ``mixed`` with ``copy`` (from 0),
    ``position`` (the copy's) and ``words`` (taken from it; less than ``size`` in a source's last round)."""
    docs = mixed.drop("copy", "words", "position")
    rows = docs.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    rows = rows.withColumn("words", F.least("size", F.col("taken") - F.col("copy") * F.col("size")))
    order = [F.col("position"), F.col("doc_id").asc_nulls_last(), F.col("copy")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
