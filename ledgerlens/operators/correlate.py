"""Pairwise-complete Pearson correlation matrices (A8, A9, A10) in one scan.

Each task turns its Arrow batches into numpy matrices and accumulates, for
every requested column pair, the moments over the rows where *both* values
are present, centred on a per-task shift (the first seen mean of each
column, for numerical stability).  A task emits one small row per pair; the
per-task moments are merged exactly with the parallel (Chan et al.) update
formulas in two small Spark aggregates, so the data is read once, nothing
but ``d*d`` rows per task is shuffled, and no group ever sees raw rows.

Semantics follow the reference: rows where either value is missing are left
out pair by pair; a constant column (or fewer than two pair rows) gives
0.0, diagonal included; results are rounded to 4 dp.  Output is long form
``(row_col, col_col, corr)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PART_SCHEMA = ("i int, j int, n double, s_i double, s_j double, a_i double, a_j double, "
                "q_i double, q_j double, p double, mn_i double, mx_i double, mn_j double, mx_j double")


def _moment_fn(d: int, pairs: list[tuple[int, int]]):
    pi = np.array([p[0] for p in pairs], dtype=np.int64)
    pj = np.array([p[1] for p in pairs], dtype=np.int64)

    def run(batches):
        shift = np.full(d, np.nan)
        n = np.zeros((d, d)); a = np.zeros((d, d)); q = np.zeros((d, d)); p = np.zeros((d, d))
        mn = np.full((d, d), np.inf); mx = np.full((d, d), -np.inf)
        seen = False
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            if x.shape[0] == 0:
                continue
            seen = True
            m = ~np.isnan(x)
            fresh = np.isnan(shift) & m.any(axis=0)
            if fresh.any():
                with np.errstate(all="ignore"):
                    shift[fresh] = np.nanmean(x[:, fresh], axis=0)
            c = np.where(m, x - np.nan_to_num(shift), 0.0)
            mf = m.astype(np.float64)
            n += mf.T @ mf
            a += c.T @ mf
            q += (c * c).T @ mf
            p += c.T @ c
            # columns that miss the same rows share their partners' extremes
            alike: dict[bytes, list[int]] = {}
            for k in range(d):
                alike.setdefault(np.packbits(m[:, k]).tobytes(), []).append(k)
            for js in alike.values():
                with_all = m & m[:, js[:1]]
                mn[:, js] = np.minimum(mn[:, js], np.where(with_all, x, np.inf).min(axis=0)[:, None])
                mx[:, js] = np.maximum(mx[:, js], np.where(with_all, x, -np.inf).max(axis=0)[:, None])
        if not seen:
            return
        sh = np.nan_to_num(shift)
        out = pd.DataFrame({
            "i": pi.astype(np.int32), "j": pj.astype(np.int32), "n": n[pi, pj],
            "s_i": sh[pi], "s_j": sh[pj], "a_i": a[pi, pj], "a_j": a[pj, pi],
            "q_i": q[pi, pj], "q_j": q[pj, pi], "p": p[pi, pj],
            "mn_i": mn[pi, pj], "mx_i": mx[pi, pj], "mn_j": mn[pj, pi], "mx_j": mx[pj, pi],
        })
        yield out

    return run


def pairs_of(cols: list[str], rows: list[str], columns: list[str]) -> list[tuple[int, int]]:
    """The index pairs of rows x columns, and each column with itself."""
    idx = {c: k for k, c in enumerate(cols)}
    asked = list(dict.fromkeys([*rows, *columns]))
    return list(dict.fromkeys([(idx[r], idx[c]) for r in rows for c in columns] + [(idx[c], idx[c]) for c in asked]))


def moment_parts(df: DataFrame, cols: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """One row of moments per task and pair."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return x.mapInPandas(_moment_fn(len(cols), pairs), _PART_SCHEMA)


def row_parts(spark: SparkSession, cols: list[str], pairs: list[tuple[int, int]], row: dict, times: int = 1) -> DataFrame:
    """The moments of one row (NULL and NaN are missing), taken ``times`` times."""
    x = [None if row.get(c) is None or row[c] != row[c] else float(row[c]) for c in cols]
    return spark.createDataFrame(
        [(i, j, float(times), x[i], x[j], 0.0, 0.0, 0.0, 0.0, 0.0, x[i], x[i], x[j], x[j])
         for i, j in pairs if times > 0 and x[i] is not None and x[j] is not None], _PART_SCHEMA)


def merge_parts(parts: DataFrame) -> DataFrame:
    """The parts of each pair as one part, centred on the pair's means: parts
    merge to parts, so moments may be stored and merged again."""
    w = Window.partitionBy("i", "j")
    tot_n = F.nullif(F.sum("n").over(w), F.lit(0.0))
    moved = (parts
             .withColumn("m_i", (F.sum(F.col("n") * F.col("s_i")).over(w) + F.sum("a_i").over(w)) / tot_n)
             .withColumn("m_j", (F.sum(F.col("n") * F.col("s_j")).over(w) + F.sum("a_j").over(w)) / tot_n)
             .withColumn("d_i", F.col("s_i") - F.col("m_i"))
             .withColumn("d_j", F.col("s_j") - F.col("m_j")))

    def about(q: str, x: str, y: str) -> Column:
        return F.sum(F.col(q) + F.col(f"d_{x}") * F.col(f"a_{y}") + F.col(f"d_{y}") * F.col(f"a_{x}")
                     + F.col("n") * F.col(f"d_{x}") * F.col(f"d_{y}"))

    zero = F.lit(0.0)
    return moved.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.coalesce(F.first("m_i"), zero).alias("s_i"), F.coalesce(F.first("m_j"), zero).alias("s_j"),
        F.coalesce(about("q_i", "i", "i"), zero).alias("q_i"), F.coalesce(about("q_j", "j", "j"), zero).alias("q_j"),
        F.coalesce(about("p", "i", "j"), zero).alias("p"),
        F.min("mn_i").alias("mn_i"), F.max("mx_i").alias("mx_i"), F.min("mn_j").alias("mn_j"), F.max("mx_j").alias("mx_j")
    ).select("i", "j", "n", "s_i", "s_j", zero.alias("a_i"), zero.alias("a_j"), "q_i", "q_j", "p", "mn_i", "mx_i", "mn_j", "mx_j")


def correlation_long(df: DataFrame, cols: list[str], rows: list[str] | None = None,
                     columns: list[str] | None = None) -> DataFrame:
    """Correlations of ``rows`` x ``columns`` (default: all of ``cols``) over
    ``df``; every pair uses only the rows where both values are present.
    Columns without any value (P20) are left out: their emptiness is seen in
    the same pass, as the count of a column with itself."""
    rows, columns = rows or cols, columns or cols
    return correlation_of(merge_parts(moment_parts(df, cols, pairs_of(cols, rows, columns))), cols, rows, columns)


def correlation_of(merged: DataFrame, cols: list[str], rows: list[str], columns: list[str]) -> DataFrame:
    """The matrix of merged moments."""
    denom = F.sqrt(F.col("q_i") * F.col("q_j"))
    degenerate = (F.col("n") < 2) | (F.col("mn_i") == F.col("mx_i")) | (F.col("mn_j") == F.col("mx_j")) | (denom <= 0)
    corr = F.when(degenerate, F.lit(0.0)).otherwise(F.col("p") / denom)
    corr = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))
    names = F.array(*[F.lit(c) for c in cols])
    found = merged.select(
        F.element_at(names, F.col("i") + 1).alias("row_col"),
        F.element_at(names, F.col("j") + 1).alias("col_col"),
        F.round(corr, 4).alias("corr"), "n")
    # one row for each pair from here on; the count of a column with itself tells whether it holds anything
    own = F.when(F.col("row_col") == F.col("col_col"), F.col("n"))
    seen = (found.withColumn("_r", F.max(own).over(Window.partitionBy("row_col")))
            .withColumn("_c", F.max(own).over(Window.partitionBy("col_col"))))
    return (seen.filter((F.col("_r") > 0) & (F.col("_c") > 0) & F.col("row_col").isin(list(rows)) & F.col("col_col").isin(list(columns)))
            .select("row_col", "col_col", "corr"))


def apply_overrides(df: DataFrame, overrides: dict[str, float] | None) -> tuple[DataFrame, list[str]]:
    """A non-NULL, non-zero override replaces the whole factor column
    with a constant; returns the frame and the overridden names."""
    ov = {k: v for k, v in (overrides or {}).items() if v is not None and v != 0}
    if not ov:
        return df, []
    return df.withColumns({k: F.lit(float(v)) for k, v in ov.items()}), list(ov)
