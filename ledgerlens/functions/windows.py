"""Order-dependent helpers that stay balanced when one account is huge.

A plain ``Window.partitionBy("account_id")`` puts a whole account in one task.
These helpers split each account's timeline into time buckets, do the
ordered work inside ``(account, bucket)`` partitions and stitch buckets
together through a small per-bucket summary (one row per account and bucket).

A bucket that holds more than ``HOT_ROWS`` rows (one account, one day; or one
midnight that all rows share) is cut once more, at equi-depth boundaries on time
and, at times that are boundaries themselves, on the tie column; see ``ordered``.

Where an account has few rows, its buckets are as many as its rows and a summary of them costs as much as
the rows themselves.  Accounts of at most ``GROUP_ROWS`` rows are therefore gone through in one window
each, and only the larger ones in buckets; see ``by_size``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bkt"
# (keys, bucket) as one value that is never null, so that rows with null keys meet in a plain join and
# the rows stay where the window over it has put them
_PLACE = "__place"
HOT_ROWS = 1_000_000       # of one (key, bucket) before it is cut again
CUTS = 64                  # boundaries on time and on the tie column of such a bucket
HASH_GROUPS = 1 << 16      # of keys: counted first, to find those that can hold a hot key
GROUP_ROWS = 50_000        # of one key, up to which one window takes all its rows
NO_TIME = (1 << 62)        # after every time bucket: rows without a time come last, in tie order


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """Number of the time bucket; rows without a time share a last bucket of their own."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.floor(F.unix_micros(c) / F.lit(int(seconds) * 1_000_000)).cast("long"), F.lit(NO_TIME))


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int, out: str = "__group") -> tuple[DataFrame, DataFrame]:
    """(``df`` with the hash group ``out`` of its ``keys``, the groups of more than ``rows`` rows, for a broadcast).

    A key of more rows makes its group hot, so keys need counting one by one only in the groups returned,
    and all others have at most ``rows`` rows; nothing but one row per group and task is shuffled."""
    d = df.withColumn(out, F.pmod(F.xxhash64(*keys), F.lit(HASH_GROUPS)))
    groups = d.groupBy(out).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > rows).select(out)
    return d, F.broadcast(groups)          # at most HASH_GROUPS rows


def large_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The ``keys`` of more than ``rows`` rows, counted one by one in their hash groups only."""
    d, groups = hot_groups(df.select(*keys), keys, rows)
    sizes = d.join(groups, "__group", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return sizes.where(F.col("__rows") > rows).select(*keys)


def by_size(df: DataFrame, keys: Sequence[str], large: DataFrame, whole: Callable[[DataFrame], DataFrame],
            bucketed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``bucketed`` of the rows whose ``keys`` are in ``large`` and ``whole`` of all others, the same columns.

    Whether there are any large keys is counted at once, so that the plan of a table without them has one part."""
    keys = list(keys)
    if large.isEmpty():
        return whole(df)
    few = F.broadcast(large)            # each stands for many rows of the table
    rest = whole(_same(df, few, keys, "left_anti"))
    return bucketed(_same(df, few, keys, "left_semi")).unionByName(rest)


def ordered(df: DataFrame, keys: Sequence[str], ts: str, tie: str, bucket: Column,
            hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``_BUCKET``: a struct that rises with ``bucket`` and, inside a bucket of more
    than ``hot_rows`` rows, with (ts, tie).

    The boundaries are ``CUTS`` approximate quantiles of the time and of the tie column of a hot
    bucket (one row per hot bucket; no row at all where none is hot).  With t boundaries below a
    row's time, the row stands in part 2t, or in part 2t + 1 where its time is the next boundary
    itself; such rows are parted again by the boundaries of the tie column at or below theirs."""
    hot = HOT_ROWS if hot_rows is None else hot_rows
    d = df.withColumn("__day", bucket)
    us = F.unix_micros(F.col(ts))
    narrow, groups = hot_groups(d.select(*keys, "__day", us.alias("__us"), F.col(tie).cast("double").alias("__tie")),
                                [*keys, "__day"], hot)
    narrow = narrow.join(groups, "__group", "left_semi")
    sizes = narrow.groupBy(*keys, "__day").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot)
    shares = [i / CUTS for i in range(1, CUTS)]
    # one row for more than ``hot`` rows of the table, so both are small beside it
    cuts = F.broadcast(_same(narrow, F.broadcast(sizes.select(*keys, "__day")), [*keys, "__day"], "left_semi")
                       .groupBy(*keys, "__day").agg(F.percentile_approx("__us", shares, 1000).alias("__t"),
                                                    F.percentile_approx("__tie", shares, 1000).alias("__s")))
    d = _same(d, cuts, [*keys, "__day"], "left")
    below = F.size(F.filter("__t", lambda x: x < us))
    at_cut = F.coalesce(F.array_contains("__t", us), F.lit(False))
    part = F.when(F.col("__t").isNull(), 0).otherwise(F.coalesce(2 * below + at_cut.cast("int"), F.lit(0)))
    # without a time there is nothing but the tie column to part by
    minor = F.when((at_cut | us.isNull()) & F.col("__s").isNotNull(),
                   F.size(F.filter("__s", lambda x: x <= F.col(tie).cast("double")))).otherwise(0)
    return d.withColumn(_BUCKET, F.struct(F.col("__day").alias("day"), part.alias("part"), minor.alias("minor"))).drop(
        "__day", "__t", "__s")


def _same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, nulls equal."""
    named = right.select(*[F.col(c).alias(f"__o_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    out = left.join(named, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__o_{c}" for c in on])


def bucketed_running_sum(df: DataFrame, keys: Sequence[str], ts: str, tie: str,
                         value: Column | str, out: str, bucket_seconds: int = 86400,
                         bucket_col: str | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over all rows of the same ``keys`` whose
    ``(ts, tie)`` is <= the current row's (inclusive running sum)."""
    keys = list(keys)
    if bucket_col is not None or not keys:
        return _running_sum_in_buckets(df, keys, ts, tie, value, out, bucket_seconds, bucket_col)
    bucketed = lambda d: _running_sum_in_buckets(d, keys, ts, tie, value, out, bucket_seconds)
    as_type = bucketed(df).schema[out].dataType

    def whole(d: DataFrame) -> DataFrame:
        v = F.col(value) if isinstance(value, str) else value
        d = d.withColumns({"__v": v, "__day": time_bucket(ts, bucket_seconds), _PLACE: F.struct(*keys)})
        upto = Window.partitionBy(_PLACE).orderBy("__day", ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # a bucket's rows before its first number have none
        here = Window.partitionBy(_PLACE, "__day").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn(out, F.sum("__v").over(upto)).withColumn("__seen", F.count("__v").over(here))
        return d.withColumn(out, F.when(F.col("__seen") > 0, F.col(out)).cast(as_type)).drop("__v", "__day", _PLACE, "__seen")
    return by_size(df, keys, large_keys(df, keys, GROUP_ROWS), whole, bucketed)


def _running_sum_in_buckets(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column | str, out: str,
                            bucket_seconds: int, bucket_col: str | None = None) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    b = bucket_col or _BUCKET
    d = df.withColumn("__v", v)
    if bucket_col is None:
        d = ordered(d, keys, ts, tie, time_bucket(ts, bucket_seconds))
    w_local = (Window.partitionBy(_PLACE).orderBy(F.col(ts), F.col(tie))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = d.groupBy(*keys, b).agg(F.sum("__v").alias("__bt"))
    w_b = (Window.partitionBy(*keys).orderBy(b)
           .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(F.struct(*keys, b).alias(_PLACE), F.coalesce(F.sum("__bt").over(w_b), F.lit(0)).alias("__off"))
    d = d.withColumn(_PLACE, F.struct(*keys, b))
    if not bucket_col:
        d = d.drop(b)
    res = d.withColumn("__local", F.sum("__v").over(w_local)).join(offsets, _PLACE, "left")
    return res.withColumn(out, F.col("__local") + F.col("__off")).drop(_PLACE, "__v", "__local", "__off")


def bucketed_prev(df: DataFrame, keys: Sequence[str], ts: str, tie: str,
                  cols: Sequence[str], prefix: str = "prev_",
                  bucket_seconds: int = 86400, bucket: Column | None = None) -> DataFrame:
    """Previous row (by ``(ts, tie)`` within ``keys``) of each column in
    ``cols`` as ``prefix + col``; null for the first row of a key.
    ``bucket`` overrides the time bucket (any expression monotone in the order)."""
    keys = list(keys)
    payload = F.struct(*[F.col(c).alias(c) for c in cols])
    b = time_bucket(ts, bucket_seconds) if bucket is None else bucket
    d = ordered(df, keys, ts, tie, b) if bucket is None else df.withColumn(_BUCKET, b)
    last = (d.groupBy(*keys, _BUCKET)
            .agg(F.max_by(payload, F.struct(F.col(ts), F.col(tie))).alias("__last")))
    w_b = Window.partitionBy(*keys).orderBy(_BUCKET)
    last = last.select(F.struct(*keys, _BUCKET).alias(_PLACE), F.lag("__last").over(w_b).alias("__bp"))
    w_local = Window.partitionBy(_PLACE).orderBy(F.col(ts), F.col(tie))
    res = (d.withColumn(_PLACE, F.struct(*keys, _BUCKET)).drop(_BUCKET)
           .withColumns({"__nth": F.row_number().over(w_local), **{prefix + c: F.lag(c).over(w_local) for c in cols}})
           .join(last, _PLACE, "left"))
    for c in cols:
        res = res.withColumn(prefix + c, F.when(F.col("__nth") == 1, F.col("__bp")[c]).otherwise(F.col(prefix + c)))
    return res.drop(_PLACE, "__nth", "__bp")


def range_count(df: DataFrame, keys: Sequence[str], ts: str, row_id: str,
                before_us: int, after_us: int, out: str,
                bucket_seconds: int = 86400, weight: Column | None = None,
                probe: Column | None = None) -> DataFrame:
    """``range_sums`` of one column: the number of rows, or the sum of ``weight``."""
    return range_sums(df, keys, ts, row_id, before_us, after_us, {out: F.lit(1) if weight is None else weight},
                      bucket_seconds, probe)


def range_sums(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, before_us: int, after_us: int,
               weights: Mapping[str, Column], bucket_seconds: int = 86400, probe: Column | None = None,
               hot_rows: int | None = None) -> DataFrame:
    """Exact sums of ``weights`` over the rows of the same ``keys`` whose
    ts lies in ``[ts - before_us, ts + after_us]`` (inclusive), for the rows
    where ``probe`` holds.  Returns ``keys + [row_id] + names of weights``.

    Each row is placed in its own time bucket and, as context only, in the
    neighbouring buckets whose rows can reach it (a small fraction when the
    bucket is wider than the window).  Inside ``(keys, bucket)`` partitions the
    sum is the difference of two growing RANGE frames (incremental, no
    sliding re-aggregation, no pairwise join, no per-account partition).  Where a bucket may hold
    more than ``hot_rows`` rows (see ``hot_groups``), rows of equal time are summed up first."""
    keys, names = list(keys), list(weights)
    width = max(int(bucket_seconds) * 1_000_000, before_us + after_us + 1)
    t = F.unix_micros(F.col(ts))
    pr = F.lit(True) if probe is None else probe
    rows = df.select(*keys, F.col(row_id), t.alias("__t"), *[w.alias(f"__w_{n}") for n, w in weights.items()],
                     pr.alias("__probe")).where(F.col("__t").isNotNull())
    total = rows.agg(*[F.sum(f"__w_{n}").alias(f"__w_{n}") for n in names]).schema
    rows = rows.withColumns({f"__w_{n}": F.col(f"__w_{n}").cast(total[f"__w_{n}"].dataType) for n in names})
    lo = F.floor((F.col("__t") - F.lit(after_us)) / F.lit(width)).cast("long")
    hi = F.floor((F.col("__t") + F.lit(before_us)) / F.lit(width)).cast("long")
    own = F.floor(F.col("__t") / F.lit(width)).cast("long") == F.col(_BUCKET)
    placed, groups = hot_groups(rows.withColumn(_BUCKET, F.explode(F.sequence(lo, hi))), [*keys, _BUCKET],
                                HOT_ROWS if hot_rows is None else hot_rows)
    hot = placed.join(groups, "__group", "left_semi")
    win = Window.partitionBy(*keys, _BUCKET).orderBy("__t")

    def summed(d: DataFrame) -> DataFrame:
        sums = {}
        for n in names:
            upto_hi = F.sum(f"__w_{n}").over(win.rangeBetween(Window.unboundedPreceding, after_us))
            below_lo = F.sum(f"__w_{n}").over(win.rangeBetween(Window.unboundedPreceding, -before_us - 1))
            sums[n] = upto_hi - F.coalesce(below_lo, F.lit(0).cast(d.schema[f"__w_{n}"].dataType))
        return d.withColumns(sums).where(own & F.col("__probe"))
    # rows of one time are one row here, however many there are
    times = hot.groupBy(*keys, "__t", _BUCKET).agg(*[F.sum(f"__w_{n}").alias(f"__w_{n}") for n in names],
                                                   F.max("__probe").alias("__probe"))
    many = _same(hot.where(own & F.col("__probe")).select(*keys, row_id, "__t"),
                 summed(times).select(*keys, "__t", *names), [*keys, "__t"], "inner")
    few = summed(placed.join(groups, "__group", "left_anti"))
    types = summed(times).schema
    return (few.select(*keys, row_id, *[F.col(n).cast(types[n].dataType).alias(n) for n in names])
            .unionByName(many.select(*keys, row_id, *names)))


def bucketed_sessions(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_us: int, out: str,
                      bucket_seconds: int = 86400) -> DataFrame:
    """1-based session number per ``keys`` in (ts, tie) order: a gap of more
    than ``gap_us`` to the previous row opens a new session; rows without a
    time come last and stay in the session before them.

    Keys that one task holds (see ``by_size``) take one window over their rows; larger ones a window inside (keys, time bucket), one per-bucket summary (first / last ts,
    internal session starts) and one prefix over the buckets of a key."""
    keys = list(keys)

    def whole(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(_PLACE).orderBy("__day", ts, tie)
        d = d.withColumns({"__us": F.unix_micros(F.col(ts)), "__day": time_bucket(ts, bucket_seconds), _PLACE: F.struct(*keys)})
        # no row without a time stands before one with a time
        d = d.withColumn("__new", F.when(F.col("__us") - F.lag("__us").over(w) > gap_us, 1).otherwise(0))
        run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return d.withColumn(out, (F.lit(1) + run).cast("int")).drop("__us", "__day", "__new", _PLACE)
    bucketed = lambda d: _sessions_in_buckets(d, keys, ts, tie, gap_us, out, bucket_seconds)
    return by_size(df, keys, large_keys(df, keys, GROUP_ROWS), whole, bucketed) if keys else bucketed(df)


def _sessions_in_buckets(df: DataFrame, keys: list[str], ts: str, tie: str, gap_us: int, out: str,
                         bucket_seconds: int) -> DataFrame:
    us = F.unix_micros(F.col(ts))
    d = ordered(df.withColumn("__us", us), keys, ts, tie, time_bucket(ts, bucket_seconds))
    d = d.withColumn(_PLACE, F.struct(*keys, _BUCKET))
    w = Window.partitionBy(_PLACE).orderBy(F.col(ts), F.col(tie))
    prev = F.lag("__us").over(w)
    d = d.withColumn("__new", F.when(prev.isNotNull() & (F.col("__us") - prev > gap_us), 1).otherwise(0))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summ = d.groupBy(*keys, _BUCKET).agg(F.min("__us").alias("__first"), F.max("__us").alias("__last"),
                                         F.sum("__new").alias("__internal"))
    wb = Window.partitionBy(*keys).orderBy(_BUCKET)
    plast = F.lag("__last").over(wb)                 # null before the first bucket; the no-time bucket is last
    summ = summ.withColumn("__fnew", F.when(plast.isNotNull() & (F.col("__first") - plast > gap_us), 1).otherwise(0))
    summ = summ.withColumn("__off", F.coalesce(F.sum(F.col("__internal") + F.col("__fnew")).over(
        wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = d.join(summ.select(F.struct(*keys, _BUCKET).alias(_PLACE), "__fnew", "__off"), _PLACE)
    r = r.withColumn(out, (F.lit(1) + F.col("__off") + F.col("__fnew") + F.col("__run")).cast("int"))
    return r.drop("__us", _PLACE, _BUCKET, "__new", "__run", "__fnew", "__off")


def carried(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
            last: Mapping[str, Column], counts: Mapping[str, Column], before: Sequence[str] = ()) -> DataFrame:
    """``df`` with, in ``order`` per ``keys``, the last non-null value of each ``last`` column up to the row
    and the sum of each of ``counts`` up to it; the names in ``before`` leave the row itself out.

    ``bucket`` rises with ``order``.  All columns share one window inside (keys, bucket), one summary of a
    row per bucket, taken from ``df`` by partial aggregation, and one prefix over the buckets of a key."""
    keys, names = list(keys), [*last, *counts]
    at = F.struct(*[F.col(c) for c in order]).alias("at")
    d = df.withColumns({_BUCKET: bucket, **{f"__c_{n}": c for n, c in {**last, **counts}.items()}})
    ends = d.groupBy(*keys, _BUCKET).agg(
        *[F.max_by(f"__c_{n}", F.when(F.col(f"__c_{n}").isNotNull(), F.struct(at))).alias(f"__e_{n}") for n in last],
        *[F.sum(f"__c_{n}").alias(f"__e_{n}") for n in counts])
    past = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, _BUCKET, *[F.last(f"__e_{n}", ignorenulls=True).over(past).alias(f"__o_{n}") for n in last],
                       *[F.sum(f"__e_{n}").over(past).alias(f"__o_{n}") for n in counts])
    here = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    upto = {n: here.rowsBetween(Window.unboundedPreceding, -1 if n in before else Window.currentRow) for n in names}
    d = d.withColumns({**{f"__h_{n}": F.last(f"__c_{n}", ignorenulls=True).over(upto[n]) for n in last},
                       **{f"__h_{n}": F.sum(f"__c_{n}").over(upto[n]) for n in counts}})
    r = _same(d, ends, [*keys, _BUCKET], "left")
    r = r.withColumns({**{n: F.coalesce(f"__h_{n}", f"__o_{n}") for n in last},
                       **{n: F.coalesce(f"__h_{n}", F.lit(0)) + F.coalesce(f"__o_{n}", F.lit(0)) for n in counts}})
    return r.drop(_BUCKET, *[f"__{x}_{n}" for x in "cho" for n in names])


def neighbours(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], col: str,
               back: int, ahead: int) -> DataFrame:
    """``df`` with ``prev_1`` .. ``prev_<back>`` and ``next_1`` .. ``next_<ahead>``: ``col`` of the rows that stand
    so far before and after the row in ``order`` per ``keys``; null where there is none.

    Rows are looked up inside (keys, bucket).  A bucket's first ``ahead`` and last ``back`` rows are its halo.
    Every bucket has a row, so the halos of as many buckets as rows are wanted hold all that a bucket lacks
    at its borders, and only halos, a bounded number of rows for each bucket, meet per key."""
    keys = list(keys)
    here = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    d = df.withColumn(_BUCKET, bucket).withColumn("__one", F.struct(F.col(col).alias("v")))
    d = d.withColumns({**{f"__b{i}": F.lag("__one", i).over(here) for i in range(1, back + 1)},
                       **{f"__a{i}": F.lead("__one", i).over(here) for i in range(1, ahead + 1)},
                       "__nth": F.row_number().over(here), "__tail": F.lead(F.lit(1), max(back, 1)).over(here).isNull()})

    def edge(keep: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("__nth", "__one")))), lambda x: x["__one"])
    halo = d.groupBy(*keys, _BUCKET).agg(edge(F.col("__nth") <= ahead).alias("__first"),
                                         edge(F.col("__tail")).alias("__last"))
    w = Window.partitionBy(*keys).orderBy(_BUCKET)
    empty = F.lit(None).cast(halo.schema["__first"].dataType)

    def joined(parts: list[Column]) -> Column:
        return F.concat(*[F.coalesce(p, F.array().cast(halo.schema["__first"].dataType)) for p in parts]) if parts else empty
    halo = halo.select(*keys, _BUCKET,
                       joined([F.reverse(F.lag("__last", i).over(w)) for i in range(1, back + 1)]).alias("__halo_b"),
                       joined([F.lead("__first", i).over(w) for i in range(1, ahead + 1)]).alias("__halo_a"))
    r = _same(d, halo, [*keys, _BUCKET], "left")
    out = {}
    for side, name, n in (("b", "prev", back), ("a", "next", ahead)):
        inside = sum((F.col(f"__{side}{i}").isNotNull().cast("int") for i in range(1, n + 1)), F.lit(0))
        for i in range(1, n + 1):
            beyond = F.get(f"__halo_{side}", F.lit(i - 1) - inside)
            out[f"{name}_{i}"] = F.coalesce(F.col(f"__{side}{i}"), beyond)["v"]
    return r.withColumns(out).drop(_BUCKET, "__one", "__nth", "__tail", "__halo_b", "__halo_a",
                                   *[f"__b{i}" for i in range(1, back + 1)], *[f"__a{i}" for i in range(1, ahead + 1)])


def range_parts(df: DataFrame, col: str, out: str, parts: int = 256, sample: int = 4096, chars: int = 256) -> DataFrame:
    """``df`` (distinct values of ``col``) with ``out``: a part number that rises with ``col``; nulls are in part -1.

    The boundaries are every ``sample`` / ``parts``-th of the ``sample`` values with the smallest hashes, so
    parts are equally deep whatever the values look like, and a rerun draws the same boundaries.  Texts are cut
    to ``chars`` characters in a boundary (one row of bounded size); those that agree so far share a part."""
    text = dict(df.dtypes)[col] == "string"
    drawn = (df.where(F.col(col).isNotNull()).select(F.col(col).alias("__x")).orderBy(F.xxhash64("__x"), "__x").limit(sample)
             .select(F.substring("__x", 1, chars).alias("__x") if text else F.col("__x")))
    step = max(1, sample // parts)
    every = (drawn.agg(F.array_sort(F.collect_list("__x")).alias("__all"))
             .select(F.filter("__all", lambda x, i: (i % step) == step - 1).alias("__cuts")))
    d = df.crossJoin(F.broadcast(every))            # one row of at most ``parts`` boundaries
    v = F.col(col)
    return d.withColumn(out, F.when(v.isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda x: x <= v)))).drop("__cuts")
