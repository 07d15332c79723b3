"""Linear models with a categorical of any number of levels (M4, M7, M8).

The one-hot block D of that categorical has a diagonal Gram matrix, the levels'
row counts, so it is eliminated from the normal equations: with z the other
columns (intercept first) and z_g, y_g, n_g a level's sums and count, the Schur
complement Z'Z + a P - sum_g z_g z_g' / (n_g + a) has the size of z alone, and a
level's coefficient is (y_g - z_g'b) / (n_g + a).  Levels are rows of a table
throughout; the driver holds matrices of the size of z.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.shared import materialise

if TYPE_CHECKING:
    from ledgerlens.operators.model import LinearModel

#: Eigenvalues of the least-squares complement below this share of the greatest of Z'Z count as zero.
RANK = 1e-10


def _stack(column: pa.ListArray) -> np.ndarray:
    """A column of equally long arrays of numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _n(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("n").to_numpy(zero_copy_only=False)


def _cells(total: np.ndarray, names: str) -> pa.RecordBatch:
    """A row for each cell of ``total``: its indices and its value."""
    return pa.RecordBatch.from_arrays([*(pa.array(x.ravel().astype(np.int32)) for x in np.indices(total.shape)), pa.array(total.ravel())], [*names, "v"])


def _level_sums(alphas: list[float], d: int, t: int):
    """Sums over the levels of z_g [z_g', y_g'] by 1 / (n_g + a) for each a, and by 1 / n_g^2."""
    def run(batches):
        total = np.zeros((len(alphas) + 1, d, d + t))
        for batch in batches:
            if batch.num_rows:
                z, n = _stack(batch.column("z")), _n(batch)
                zy = np.hstack([z, _stack(batch.column("y"))])
                for k, weight in enumerate([*(1 / (n + a) for a in alphas), 1 / (n * n)]):
                    total[k] += (z * weight[:, None]).T @ zy
        yield _cells(total, "kij")
    return run


def _row_products(d: int, t: int):
    def run(batches):
        total = np.zeros((1, d, d + t))
        for batch in batches:
            if batch.num_rows:
                z = _stack(batch.column("z"))
                total[0] += z.T @ np.hstack([z, _stack(batch.column("y"))])
        yield _cells(total, "kij")
    return run


def _gather(df: DataFrame, make, shape: tuple) -> np.ndarray:
    out = np.zeros(shape)
    for r in df.mapInArrow(make, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.k, r.i, r.j] = r.v
    return out


def least_squares(products: np.ndarray, by_count: np.ndarray, by_square: np.ndarray, d: int) -> np.ndarray:
    """The least-squares coefficients of z for which those of z and of the
    levels together (but not the intercept) have the least norm.

    Solutions differ by c in the null space of the within-level scatter, with
    -c'z_g / n_g at level g; the norm is least for a small linear system."""
    s = products[:, :d] - by_count[:, :d]
    e, v = np.linalg.eigh((s + s.T) / 2)
    zero = e <= RANK * max(np.linalg.eigvalsh(products[:, :d])[-1], 0.0)
    b = v[:, ~zero] @ ((v[:, ~zero].T @ (products[:, d:] - by_count[:, d:])) / e[~zero, None])
    null = v[:, zero]
    free = np.eye(d)
    free[0, 0] = 0.0  # the intercept isn't part of the norm
    # the levels' coefficients are the means of y - z'b: their products with the means of z
    left = null.T @ (free + by_square[:, :d]) @ null
    right = null.T @ (by_square[:, d:] - by_square[:, :d] @ b - free @ b)
    return b + null @ (np.linalg.pinv(left, rcond=RANK, hermitian=True) @ right)


def _loo(factors, d: int, t: int):
    """Sums of squared leave-one-out errors by penalty and target.  A row's
    leverage is 1 / (n_g + a) + w' S^-1 w with w = z - z_g / (n_g + a)."""
    def run(batches):
        alphas, inverses, fits = factors.value
        sse = np.zeros((len(alphas), t))
        for batch in batches:
            if batch.num_rows:
                z, y, zg, yg = (_stack(batch.column(c)) for c in ("z", "y", "zg", "yg"))
                n = _n(batch)[:, None]
                for k, (a, inverse, b) in enumerate(zip(alphas, inverses, fits)):
                    w = z - zg / (n + a)
                    leverage = 1 / (n + a) + ((w @ inverse) * w).sum(axis=1, keepdims=True)
                    error = (y - z @ b - (yg - zg @ b) / (n + a)) / (1 - leverage)
                    sse[k] += (error * error).sum(axis=0)
        yield _cells(sse, "kj")
    return run


def fit(train: DataFrame, m: LinearModel, alphas: list[float]) -> None:
    """Fits baseline and ridge (penalty of the least exact leave-one-out
    error) of every target into ``m``; ``train`` has all targets."""
    spark, targets = train.sparkSession, m.targets
    design, t = m.design(train.columns), len(m.targets)
    d = len(design) + 1
    rows = train.select(
        m.category_expr(train.columns, m.wide).alias("category"), F.array(F.lit(1.0), *design).alias("z"),
        F.array(*[F.col(y).cast("double") for y in targets]).alias("y"))
    at = lambda c, k: F.sum(F.get(c, F.lit(k)))
    levels = materialise(rows.groupBy("category").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[at("z", k) for k in range(d)]).alias("z"),
        F.array(*[at("y", k) for k in range(t)]).alias("y")), "levels")
    products = _gather(rows, _row_products(d, t), (1, d, d + t))[0]
    m.n_train = int(products[0, 0])
    if m.n_train < 1:
        raise ValueError("no training rows")
    sums = _gather(levels, _level_sums([*alphas, 0.0], d, t), (len(alphas) + 2, d, d + t))
    penalty = np.eye(d)
    penalty[0, 0] = 0.0
    inverses = [np.linalg.inv(products[:, :d] + a * penalty - sums[k, :, :d]) for k, a in enumerate(alphas)]
    fits = [inverse @ (products[:, d:] - sums[k, :, d:]) for k, inverse in enumerate(inverses)]
    factors = spark.sparkContext.broadcast((alphas, inverses, fits))
    try:
        sse = np.zeros((len(alphas), t))
        own = levels.select("category", "n", F.col("z").alias("zg"), F.col("y").alias("yg"))
        for r in rows.join(own, "category").drop("category").mapInArrow(_loo(factors, d, t), "k int, j int, v double").groupBy("k", "j").agg(
                F.sum("v").alias("v")).collect():
            sse[r.k, r.j] = r.v
    finally:
        factors.unpersist()
    plain = least_squares(products, sums[len(alphas)], sums[-1], d)
    chosen: dict[str, tuple[float, np.ndarray]] = {}
    for j, y in enumerate(targets):
        k = int(np.argmin(sse[:, j]))
        m.alphas[y] = float(alphas[k])
        chosen[f"baseline__{y}"], chosen[f"ridge__{y}"] = (0.0, plain[:, j]), (float(alphas[k]), fits[k][:, j])
        for algo in ("baseline", "ridge"):
            b = chosen[f"{algo}__{y}"][1]
            m.coefs[(algo, y)] = (float(b[0]), [float(v) for v in b[1:]])
    m.wide_table = materialise(levels.mapInArrow(
        _coefficients(targets, chosen), "category string, " + ", ".join(f"`{c}` double" for c in chosen)), "level-coefficients")


def _coefficients(targets: list[str], chosen: dict):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z, y, n = _stack(batch.column("z")), _stack(batch.column("y")), _n(batch)
                yield pa.RecordBatch.from_arrays([batch.column("category"), *(
                    pa.array((y[:, targets.index(c.split("__", 1)[1])] - z @ b) / (n + a)) for c, (a, b) in chosen.items())], ["category", *chosen])
    return run
