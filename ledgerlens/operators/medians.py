"""Exact medians that stay bounded when one group holds a third of the rows.

Groups of at most ``SMALL`` rows take ``F.median``: its buffer is bounded by
them.  Larger groups are narrowed: each round counts the values of the open
range in buckets (plain hash aggregates, combined map-side) and goes on with
the one or two buckets that hold the middle ranks, until at most ``LEFT``
values, or a single one, remain; those are ranked.  The more groups, the fewer
buckets each has, so that a task's counts stay in memory and are far fewer than
its rows.

Global medians write the values once (unless they are already) and take two
scans of them for all columns: a mergeable quantile sketch
brackets every median, and an exact pass counts the rows below each bracket
and the values inside it (about ``6 / ACCURACY`` of the rows, ties counted
together).  The counts are exact, so a bracket that missed is seen, and its
column goes through the rounds instead.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.shared import materialise

#: Rows of a group (values of a whole column's open range) that are ranked in one task.
SMALL = 65_536
#: Values of a larger group's column that are left for ranking.
LEFT = 4_096
#: Buckets of a group's column in a round, at most; fewer (to 16) where all groups together have more than CELLS.
BUCKETS, CELLS = 1024, 262_144
#: Of the quantile sketch: its ranks are off by at most a share of 1 / ACCURACY.
ACCURACY = 10_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys], F.lit(True))


def _keyed(df: DataFrame, keys: list[str], *cols) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *cols)


def exact_medians(df: DataFrame, keys: list[str], cols: list[str], written: bool = False) -> DataFrame:
    """One row per group of ``keys`` (NULL is a group value) with the exact
    median of each column in ``cols`` (NULLs and NaNs ignored; NULL when a
    group has no value).  ``keys=[]`` gives global medians in one row.
    ``written``: ``df`` is read from files, so reading it again costs no join."""
    values = {c: F.col(c).cast("double") for c in cols}
    base = df.select(*keys, *[F.when(F.isnan(v), None).otherwise(v).alias(c) for c, v in values.items()])
    if not keys:
        return _global(base if written else materialise(base, "median-values"), cols)
    big = materialise(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL), "median-groups")
    if big.isEmpty():
        return base.groupBy(*keys).agg(*[F.median(c).alias(c) for c in cols])
    hot = _keyed(big, keys)
    small = base.join(hot, _same(base, hot, keys), "left_anti").groupBy(*keys).agg(*[F.median(c).alias(c) for c in cols])
    return small.unionByName(_narrowed(base, keys, cols, hot))


def _global(base: DataFrame, cols: list[str]) -> DataFrame:
    """Medians of whole columns: sketch, exact counts, ranks.  The driver
    holds a few numbers per column."""
    spark = base.sparkSession
    seen = base.agg(*[F.struct(F.count(c).alias("n"), F.percentile_approx(c, [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY)
                               .alias("q")).alias(c) for c in cols]).first()
    full = [c for c in cols if seen[c].n]
    found: dict[str, float | None] = dict.fromkeys(cols)
    if full:
        ranks = {c: ((seen[c].n - 1) // 2, seen[c].n // 2) for c in full}
        counts = materialise(base.select(*full).mapInPandas(_inside([tuple(seen[c].q) for c in full]), "c int, v double, m long")
                             .groupBy("c", "v").agg(F.sum("m").alias("m")), "median-counts")
        totals = {full[r.c]: r for r in counts.groupBy("c").agg(
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("m"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("m"))), F.lit(0)).alias("inside"),
            F.count("v").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        hit = [c for c in full if c in totals and totals[c].below <= ranks[c][0] and ranks[c][1] < totals[c].below + totals[c].inside]
        found |= _ranked(counts.where("v is not null"), {full.index(c): (*ranks[c], totals[c]) for c in hit}, full)
        missed = [c for c in full if c not in hit]
        if missed:
            row = _narrowed(base.select(*missed).withColumn("_all", F.lit(1)), ["_all"], missed).first()
            found |= {c: row[c] for c in missed}
    return spark.createDataFrame([tuple(found[c] for c in cols)], ", ".join(f"`{c}` double" for c in cols))


def _inside(brackets: list[tuple[float, float]]):
    """(c, v, m): how often each value inside its column's bracket occurs in a
    batch, and, with v NULL, how many rows of the task lie below."""
    def run(batches):
        below = np.zeros(len(brackets), dtype=np.int64)
        for pdf in batches:
            got = []
            for k, (lo, hi) in enumerate(brackets):
                x = pdf.iloc[:, k].to_numpy(dtype=np.float64, na_value=np.nan)
                below[k] += int((x < lo).sum())
                v, m = np.unique(x[(x >= lo) & (x <= hi)], return_counts=True)
                if len(v):
                    got.append(pd.DataFrame({"c": np.full(len(v), k, dtype=np.int32), "v": v, "m": m.astype(np.int64)}))
            if got:
                yield pd.concat(got)
        yield pd.DataFrame({"c": np.arange(len(brackets), dtype=np.int32), "v": pd.Series([None] * len(brackets), dtype="Float64"), "m": below})

    return run


def _ranked(counts: DataFrame, want: dict[int, tuple], names: list[str]) -> dict[str, float]:
    """Medians from value counts.  ``want``: column -> its middle ranks and
    its totals.  A column of more than ``SMALL`` values is narrowed by buckets
    of the counts first, so one task orders at most that many."""
    openr = {k: [lo, hi, t.below, t.values, t.lo, t.hi] for k, (lo, hi, t) in want.items()}
    if not openr:
        return {}
    found = {}

    def of(k_to: dict) -> Column:
        return F.element_at(F.create_map(*[x for k, v in k_to.items() for x in (F.lit(k), F.lit(v))]), F.col("c"))

    def ranges(ks) -> Column:
        return F.col("c").isin(list(ks)) & F.col("v").between(of({k: openr[k][4] for k in ks}), of({k: openr[k][5] for k in ks}))

    while wide := [k for k, r in openr.items() if r[3] > SMALL]:
        lo, hi = of({k: openr[k][4] for k in wide}), of({k: openr[k][5] for k in wide})
        share = (F.col("v") - lo) / F.nullif(hi - lo, F.lit(0.0))
        share = F.when(F.isnan(share) | share.isNull(), 0.0).otherwise(share)
        # the least value has a bucket to itself, so every round narrows
        b = F.when(F.col("v") == lo, 0).otherwise(1 + F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int"))
        hist = (counts.where(ranges(wide)).groupBy("c", b.alias("b"))
                .agg(F.sum("m").alias("m"), F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .orderBy("c", "b").collect())  # at most BUCKETS + 1 rows a column
        for k in wide:
            low, high, at = openr[k][0], openr[k][1], openr[k][2]
            held = []
            for r in (r for r in hist if r.c == k):
                if at <= low < at + r.m or at <= high < at + r.m:
                    held.append((at, r))
                at += r.m
            if len(held) == 2:  # the ranks are the last value of one and the first of the next
                found[names[k]] = (held[0][1].hi + held[1][1].lo) / 2
                del openr[k]
            else:
                openr[k] = [low, high, held[0][0], held[0][1].n, held[0][1].lo, held[0][1].hi]
    if openr:
        w = Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum("m").over(w) + of({k: r[2] for k, r in openr.items()})
        low, high = of({k: r[0] for k, r in openr.items()}), of({k: r[1] for k, r in openr.items()})
        rows = (counts.where(ranges(openr)).withColumn("end", end).withColumn("start", F.col("end") - F.col("m"))
                .where(((F.col("start") <= low) & (low < F.col("end"))) | ((F.col("start") <= high) & (high < F.col("end"))))
                .groupBy("c").agg(((F.min("v") + F.max("v")) / 2).alias("v")).collect())
        found |= {names[r.c]: r.v for r in rows}
    return found


def _narrowed(base: DataFrame, keys: list[str], cols: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Medians of the groups of ``base`` (of those in ``hot`` alone, if given)
    by narrowing.  ``state`` holds for each group its number ``_g``, its keys
    and for each column: n values in all, ``below`` the open range [lo, hi]
    and ``inside`` it."""
    rows = base if hot is None else base.join(hot, _same(base, hot, keys), "left_semi")
    wide = rows.groupBy(*keys).agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols])
    state = materialise(wide.select(F.monotonically_increasing_id().alias("_g"), *keys, *[
        F.struct(F.col(f"{c}.n").alias("n"), F.lit(0).cast("long").alias("below"), F.col(f"{c}.lo").alias("lo"), F.col(f"{c}.hi").alias("hi"),
                 F.col(f"{c}.n").alias("inside")).alias(c) for c in cols]), "median-state")
    buckets = min(BUCKETS, max(16, CELLS // max(1, state.count() * len(cols))))
    limit, first = min(SMALL, LEFT), True
    while True:
        still = F.greatest(*[F.when(F.col(f"{c}.lo") < F.col(f"{c}.hi"), F.col(f"{c}.inside")).otherwise(0) for c in cols], F.lit(0))
        if (state.agg(F.max(still)).first()[0] or 0) <= limit:
            break
        # columns and groups that are narrow enough aren't counted again
        state, first = materialise(_round(_open(base, state, keys, cols, buckets, first, more_than=limit), state, cols), "median-state"), False
    left = _open(base, state, keys, cols, buckets, False).groupBy("_g", "_c").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    joined = state.join(_by_column(left, "_s", cols), F.col("_g") == F.col("_h"), "left")

    def middle(c: str) -> Column:
        at = lambda r: F.when(F.col(f"{c}.lo") < F.col(f"{c}.hi"), F.get(f"_s_{c}", (r - F.col(f"{c}.below")).cast("int"))).otherwise(F.col(f"{c}.lo"))
        low = F.floor((F.col(f"{c}.n") - 1) / 2)
        value = (at(low) + at(F.ceil((F.col(f"{c}.n") - 1) / 2))) / 2
        lost = (F.col(f"{c}.n") > 0) & value.isNull()
        return F.when(lost, F.raise_error(F.lit("a group with values has no median")).cast("double")).otherwise(value).alias(c)

    return joined.select(*keys, *[middle(c) for c in cols])


def _by_column(df: DataFrame, value: str, cols: list[str]) -> DataFrame:
    """(_h, _s_*): ``value`` of each column of a group, from (_g, _c, value)."""
    wide = df.groupBy("_g").pivot("_c", list(range(len(cols)))).agg(F.first(value))
    return wide.select(F.col("_g").alias("_h"), *[F.col(str(k)).alias(f"_s_{c}") for k, c in enumerate(cols)])


def _open(base: DataFrame, state: DataFrame, keys: list[str], cols: list[str], buckets: int, first: bool, more_than: int = 0) -> DataFrame:
    """(_g, _c, _v, _b): the values of open ranges of more than one value (and
    more than ``more_than`` rows) with their buckets.  The least and the greatest
    value have buckets of their own, so every round narrows and infinite ends go
    at once; the first round's buckets are logarithmic, for long tails."""
    groups = _keyed(state, keys, "_g")
    ranges = state.select(F.col("_g").alias("_h"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("c"), *[F.col(f"{c}.{x}").alias(x) for x in ("lo", "hi", "inside")]) for k, c in enumerate(cols)])).alias("_x")
    ).select("_h", "_x.*").where((F.col("lo") < F.col("hi")) & (F.col("inside") > more_than))
    # a value a row before the ranges join them, so that its bucket is one short expression
    values = base.join(groups, _same(base, groups, keys)).select("_g", F.posexplode(F.array(*cols)).alias("_c", "_v"))
    j = values.join(ranges, (F.col("_g") == F.col("_h")) & (F.col("_c") == F.col("c"))).where(F.col("_v").between(F.col("lo"), F.col("hi")))

    def scale(x: str) -> Column:
        return F.signum(x) * F.log1p(F.abs(x)) if first else F.col(x)

    share = (scale("_v") - scale("lo")) / F.nullif(scale("hi") - scale("lo"), F.lit(0.0))
    inner = F.floor(F.when(F.isnan(share) | share.isNull(), 0.0).otherwise(share) * buckets)
    b = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), buckets + 1).otherwise(1 + F.least(F.lit(buckets - 1), inner).cast("int"))
    return j.select("_g", "_c", "_v", b.alias("_b"))


def _round(opened: DataFrame, state: DataFrame, cols: list[str]) -> DataFrame:
    hist = opened.groupBy("_g", "_c", "_b").agg(F.count(F.lit(1)).alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    long = state.select(F.col("_g").alias("_h"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("c"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.below").alias("below")) for k, c in enumerate(cols)])).alias("_x")).select("_h", "_x.*")
    # a group's column has at most BUCKETS + 2 rows here
    w = Window.partitionBy("_g", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    h = (hist.join(long, (F.col("_g") == F.col("_h")) & (F.col("_c") == F.col("c")))
         .withColumn("end", F.sum("m").over(w) + F.col("below")).withColumn("start", F.col("end") - F.col("m")))
    holds = lambda r: (F.col("start") <= r) & (r < F.col("end"))
    mid = h.filter(holds(F.floor((F.col("n") - 1) / 2)) | holds(F.ceil((F.col("n") - 1) / 2)))
    # ranks in two buckets are the last value of one and the first of the next: the median is known
    between = F.when(F.count(F.lit(1)) == 2, (F.min_by("hi", "start") + F.max_by("lo", "start")) / 2)
    new = mid.groupBy("_g", "_c").agg(F.struct(
        F.max("n").alias("n"), F.min("start").alias("below"), F.coalesce(between, F.min("lo")).alias("lo"),
        F.coalesce(between, F.max("hi")).alias("hi"), F.sum("m").alias("inside")).alias("s"))
    got = _by_column(new, "s", cols)
    return state.join(got, F.col("_g") == F.col("_h"), "left").select("_g", *[c for c in state.columns if c not in ("_g", *cols)], *[
        F.coalesce(F.col(f"_s_{c}"), F.col(c)).alias(c) for c in cols])
