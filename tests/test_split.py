"""The exact split at any grain, against sorting on the driver."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import split


def _values(spark, rows):
    return spark.createDataFrame([(v,) for v in rows], "v long")


@pytest.mark.parametrize("few", [65_536, 3])
def test_nth_smallest_by_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(split, "FEW", few)
    rows = [-(1 << 63), -(1 << 63), -5, -5, -5, 0, 1, 2, 3, 4, 5, 6, (1 << 62), (1 << 62) + 1, (1 << 63) - 1]
    df = _values(spark, rows).cache()
    for n in (1, 2, 4, 6, 9, 13, 15):
        v = sorted(rows)[n - 1]
        assert split.nth_smallest(df, F.col("v"), n) == (v, sum(x < v for x in rows), rows.count(v))
    with pytest.raises(ValueError):
        split.nth_smallest(df, F.col("v"), 16)


@pytest.mark.parametrize("size", [0.25, 0.01, 0.999, 0.0])
def test_sizes_ties_and_equal_rows(spark, monkeypatch, size):
    """Unique keys, one key with a third of the rows, NULL keys, and a row
    that is there 700 times: always ceil(n * size) test rows, no row lost."""
    monkeypatch.setattr(split, "BLOCK", 64)
    rows = [(k, f"r{k}") for k in range(600)] + [(7, f"hot{j}") for j in range(700)] + [(8, "same")] * 700 + [(None, None)] * 5
    df = spark.createDataFrame(rows, "k long, t string")
    for key in (["k"], ["k", "t"]):
        got = split.exact_split(df, key, size, 42).collect()
        again = split.exact_split(df.repartition(5), key, size, 42).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        assert sum(r._test for r in got) == math.ceil(len(rows) * size)
        assert sorted(map(str, [(r.k, r.t) for r in got])) == sorted(map(str, rows))
    for same in (([(1, "a")] * 100), []):
        got = split.exact_split(spark.createDataFrame(same, "k long, t string"), ["k"], size, 42).collect()
        assert len(got) == len(same) and sum(r._test for r in got) == math.ceil(len(same) * size)
