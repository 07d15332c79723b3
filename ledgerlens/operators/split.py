"""Exact train / test split at any grain.

The test rows are the ``ceil(n * test_size)`` rows of least hash.  The last of
these hashes is found by narrowing: counts of 4,096 ranges of the hash, then of
4,096 parts of the range that holds it, until at most ``FEW`` hashes remain,
which are counted one by one.  The split is then a comparison per row: nothing
is ordered and no window spans the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.shared import materialise

#: Different hashes that the driver may count one by one.
FEW = 65_536
#: Rows that one task writes again where more equal rows than one share the last place.
BLOCK = 65_536
_BITS = 12


def nth_smallest(df: DataFrame, value: Column, n: int) -> tuple[int, int, int]:
    """(the n-th smallest LONG, rows below it, rows equal to it); n from 1.
    Two to seven aggregates over ``df``, each of at most FEW groups."""
    v = df.select(value.alias("v"))
    bits, low, below = 64, -(1 << 63), 0
    held = None
    while bits > 0 and (held is None or held > FEW):
        shift = max(0, bits - _BITS)
        counts = v.groupBy(F.shiftright("v", shift).alias("b")).count().collect()
        for b, c in sorted(counts):
            if below + c >= n:
                low, bits, held = b << shift, shift, c
                break
            below += c
        else:
            raise ValueError(f"fewer than {n} values")
        v = v.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(low + (1 << bits) - 1)))
    if bits == 0:
        return low, below, held
    for x, c in sorted(v.groupBy("v").count().collect()):
        if below + c >= n:
            return x, below, c
        below += c
    raise ValueError(f"fewer than {n} values")


def exact_split(df: DataFrame, key_cols: list[str], test_size: float, seed: int, written: bool = False) -> DataFrame:
    """``df`` with ``_test``: true for exactly ``ceil(n * test_size)`` rows, the
    same whenever the rows are.  Rows of equal keys at the last place are told
    apart by a hash of all columns; of wholly equal rows there as many as are
    needed go to the test side (they are written again by blocks, so any number
    of them is dealt to many tasks).  An empty frame stays empty.  The rows are
    read up to ten times, so they are written once, unless they are already."""
    if not written:
        df = materialise(df, "split-rows")
    n_test = math.ceil(df.count() * test_size)
    if n_test < 1:
        return df.withColumn("_test", F.lit(False))
    h = F.xxhash64(*[F.col(f"`{c}`") for c in key_cols], F.lit(seed))
    last, below, equal = nth_smallest(df, h, n_test)
    if below + equal == n_test:
        return df.withColumn("_test", h <= F.lit(last))
    tied = df.where(h == F.lit(last))
    # columns in order of their names, so their order in the frame decides nothing
    h2 = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)], F.lit(seed + 1))
    last2, below2, equal2 = nth_smallest(tied, h2, n_test - below)
    need = n_test - below - below2
    if need == equal2:
        return df.withColumn("_test", (h < F.lit(last)) | ((h == F.lit(last)) & (h2 <= F.lit(last2))))
    same = (h == F.lit(last)) & (h2 == F.lit(last2))
    rest = df.where(~same).withColumn("_test", (h < F.lit(last)) | ((h == F.lit(last)) & (h2 < F.lit(last2))))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(BLOCK).cast("long")))
    blocks = (df.where(same).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_at", start).repartition(F.col("_at")))
    place = F.explode(F.sequence(F.col("_at") + 1, F.least(F.col("_at") + BLOCK, F.col("_n"))))
    again = blocks.withColumn("_place", place).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_place") <= F.lit(need)).alias("_test"))
    return rest.unionByName(again)
