"""Rectangle sums over points: how many points of a cell lie in ``[u_lo, u_hi] x [v_lo, v_hi]``.

No pair of a query and a point is ever built.  A rectangle is four corner sums ("all points with
u <= U and v <= V") with signs.  A cell of more than ``tile_rows`` points is cut at equi-depth
boundaries of u (slabs) and of v (strips); a boundary value is a part of its own, so that only the
open intervals between boundaries are ever met in part, however many points share one value.  A
corner sum is then

* the points of the strip that V falls into, with u <= U and v <= V (strip tile),
* in the strips below it, the points of the slab that U falls into, with u <= U (slab tile),
* in those strips, all points of the slabs below it (grid tile: one weighted point per slab and strip).

Each tile is one group: its points, and the corners that ask it in chunks of ``tile_rows`` (the
points are copied once per chunk, so copies grow with points plus corners).  Inside a tile a
counting tree over the ranks of v answers all corners at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_ROWS = 100_000        # points, and corners, of one task's group
CUTS = 256                 # parts of a cell beyond that, in either direction


def corner_sums(u: np.ndarray, v: np.ndarray, w: np.ndarray, at_u: np.ndarray, at_v: np.ndarray) -> np.ndarray:
    """For every corner the sum of ``w`` over the points with u <= at_u and v <= at_v.

    The points stand in order of u; the ranks of v are parted bit by bit from the highest, keeping
    that order, and a corner follows the bits of its own rank with the range of points it covers."""
    n = len(u)
    total = np.zeros(len(at_u), dtype=np.int64)
    if n == 0 or len(at_u) == 0:
        return total
    by_u = np.argsort(u, kind="stable")
    by_v = np.argsort(v, kind="stable")
    first, last = np.zeros(len(at_u), dtype=np.int64), np.searchsorted(u[by_u], at_u, side="right")
    below = np.searchsorted(v[by_v], at_v, side="right")      # ranks from 0 to below - 1 count
    rank = np.empty(n, dtype=np.int64)
    rank[by_v] = np.arange(n)
    rank, w = rank[by_u], np.asarray(w, dtype=np.int64)[by_u]
    for bit in range(n.bit_length() - 1, -1, -1):
        is_zero = (rank >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(is_zero)])
        weight = np.concatenate([[0], np.cumsum(np.where(is_zero, w, 0))])
        takes = (below >> bit) & 1 == 1
        z_first, z_last = zeros[first], zeros[last]
        total += np.where(takes, weight[last] - weight[first], 0)
        first = np.where(takes, zeros[-1] + first - z_first, z_first)
        last = np.where(takes, zeros[-1] + last - z_last, z_last)
        step = np.concatenate([np.flatnonzero(is_zero), np.flatnonzero(~is_zero)])
        rank, w = rank[step], w[step]
    return total


def _part(x: str, cuts: str) -> Column:
    """2k between the k-th and the next boundary, 2k + 1 on that next boundary."""
    return (2 * F.size(F.filter(cuts, lambda c: c < F.col(x)))
            + F.array_contains(cuts, F.col(x)).cast("int")).cast("long")


def _open(part: Column) -> Column:
    return part % 2 == 0


def rectangle_sums(points: DataFrame, queries: DataFrame, cell: Sequence[str], ids: Sequence[str], out: str,
                   tile_rows: int = TILE_ROWS, cuts: int = CUTS) -> DataFrame:
    """``cell + ids + [out]``: per query row the sum of ``w`` over the points of its cell with
    u_lo <= u <= u_hi and v_lo <= v <= v_hi (all long); queries that no corner answers are absent (sum 0).

    ``points``: cell columns, ``u``, ``v``, ``w``.  ``queries``: cell columns, id columns (unique in
    a cell), ``u_lo u_hi v_lo v_hi``.  Rows with a null cell column match nothing."""
    cell, ids = list(cell), list(ids)
    tile = [*cell, "__kind", "__tile"]
    points, queries = points.select(*cell, "u", "v", "w"), queries.select(*cell, *ids, "u_lo", "u_hi", "v_lo", "v_hi")
    sizes = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.min("u").alias("__u0"), F.min("v").alias("__v0"))
    shares = [i / cuts for i in range(1, cuts)]
    bounds = (points.join(sizes.where(F.col("__n") > tile_rows).select(*cell), cell, "left_semi").groupBy(*cell)
              .agg(*[F.array_distinct(F.percentile_approx(c, shares, 10_000)).alias(f"__c{c}") for c in "uv"]))
    none = F.array().cast("array<bigint>")
    cells = sizes.join(bounds, cell, "left").select(
        *cell, "__u0", "__v0", F.coalesce("__cu", none).alias("__cu"), F.coalesce("__cv", none).alias("__cv"),
        F.col("__cu").isNotNull().alias("__cut"))

    def tiles(entries: list[tuple[Column, int, Column, Column, Column]]) -> Column:
        """One struct per tile that the row takes part in."""
        return F.explode(F.array_compact(F.array(*[
            F.when(when, F.struct(F.lit(kind).alias("kind"), no.alias("tile"), a.alias("u"), b.alias("v")))
            for when, kind, no, a, b in entries])))

    at = F.col("__at")
    slab, strip = F.col("__slab"), F.col("__strip")
    placed = points.join(cells, cell).withColumns({"__slab": _part("u", "__cu"), "__strip": _part("v", "__cv")})
    grid = (placed.where("__cut").groupBy(*cell, "__slab", "__strip").agg(F.sum("w").alias("w"))
            .select(*cell, F.lit(2).alias("__kind"), F.lit(0).cast("long").alias("__tile"),
                    slab.alias("u"), strip.alias("v"), "w"))
    placed = (placed.withColumn("__at", tiles([
        (_open(strip), 0, strip, F.col("u"), F.col("v")),
        (F.col("__cut") & _open(slab), 1, slab, F.col("u"), strip)]))
        .select(*cell, at["kind"].alias("__kind"), at["tile"].alias("__tile"), at["u"].alias("u"), at["v"].alias("v"), "w"))
    placed = placed.unionByName(grid)

    def corner(u: Column, v: Column, sign: int) -> Column:
        return F.struct(u.alias("u"), v.alias("v"), F.lit(sign).cast("long").alias("w"))

    u_lo, u_hi, v_lo, v_hi = (F.col(c) for c in ("u_lo", "u_hi", "v_lo", "v_hi"))
    asked = (queries.withColumn("__at", F.explode(F.array(
        corner(u_hi, v_hi, 1), corner(u_lo - 1, v_hi, -1), corner(u_hi, v_lo - 1, -1), corner(u_lo - 1, v_lo - 1, 1))))
        .select(*cell, *ids, "__at.*").join(cells, cell)
        .where((F.col("u") >= F.col("__u0")) & (F.col("v") >= F.col("__v0")))
        .withColumns({"__slab": _part("u", "__cu"), "__strip": _part("v", "__cv")}))
    slabs, strips = slab - _open(slab).cast("long"), strip - _open(strip).cast("long")     # last whole one; -1: none
    asked = (asked.withColumn("__at", tiles([
        (_open(strip), 0, strip, F.col("u"), F.col("v")),
        (F.col("__cut") & _open(slab) & (strips >= 0), 1, slab, F.col("u"), strips),
        (F.col("__cut") & (slabs >= 0) & (strips >= 0), 2, F.lit(0).cast("long"), slabs, strips)]))
        .select(*cell, *ids, at["kind"].alias("__kind"), at["tile"].alias("__tile"),
                at["u"].alias("u"), at["v"].alias("v"), "w"))

    chunks = asked.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("long").alias("__chunks"))
    chunk = F.pmod(F.xxhash64(*ids, "u", "v"), F.col("__chunks")).alias("__chunk")
    asked = asked.join(chunks, tile).select(*tile, chunk, *ids, "u", "v", "w", F.lit(True).alias("__asks"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1)).alias("__chunk")
    types = {f.name: f.dataType for f in queries.schema}
    rows = (placed.join(chunks, tile).select(*tile, copies, *[F.lit(None).cast(types[c]).alias(c) for c in ids],
                                             "u", "v", "w", F.lit(False).alias("__asks"))
            .unionByName(asked))

    def answer(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        asks = part["__asks"].to_numpy(dtype=bool)
        p, q = part[~asks], part[asks]
        got = corner_sums(*(p[c].to_numpy(dtype=np.int64) for c in ("u", "v", "w")),
                          *(q[c].to_numpy(dtype=np.int64) for c in ("u", "v")))
        return q[cell + ids].assign(**{out: got * q["w"].to_numpy(dtype=np.int64)})

    schema = T.StructType([T.StructField(c, types[c]) for c in cell + ids] + [T.StructField(out, T.LongType())])
    return rows.groupBy(*tile, "__chunk").applyInPandas(answer, schema).groupBy(*cell, *ids).agg(F.sum(out).alias(out))


def order_key(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the (finite) doubles; both zeros are 0."""
    bits = (np.asarray(x, dtype=np.float64) + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, -(bits & np.iinfo(np.int64).max))


def from_order_key(k: np.ndarray) -> np.ndarray:
    size = np.abs(k).view(np.float64)
    return np.where(k >= 0, size, -size)


def tolerance_keys(a: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest order key whose double x satisfies |a - x| / |a| <= tol exactly as
    computed in doubles (x = 0 only, for a = 0), by bisection: the quotient never falls as x leaves a."""
    a = np.asarray(a, dtype=np.float64)
    own = order_key(a)
    ends = []
    for limit in (-np.finfo(np.float64).max, np.finfo(np.float64).max):
        inside, outside = own, np.full(len(a), order_key(np.array([limit]))[0] + (1 if limit > 0 else -1))
        for _ in range(65):                    # the longs between them halve
            mid = (inside >> 1) + (outside >> 1) + (inside & outside & 1)
            with np.errstate(all="ignore"):
                fits = np.abs(a - from_order_key(mid)) / np.abs(a) <= tol
            inside, outside = np.where(fits, mid, inside), np.where(fits, outside, mid)
        ends.append(np.where(a == 0, 0, inside))
    return ends[0], ends[1]
