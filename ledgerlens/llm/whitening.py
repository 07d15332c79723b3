"""Whitening of embeddings by FEAST.

Spark makes the centred covariance over the distinct vectors in one pass; the
matrix has the size of a vector squared, whatever the number of rows.  Its
leading components come from contour integration: Gauss-Legendre quadrature of
shifted complex solves projects a block of vectors onto the eigenvectors of an
interval, Rayleigh-Ritz extracts them, and inertia counts of the shifted matrix
set the interval and verify that none is missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise
from ledgerlens.llm.vectors import matrix, on_grid, usable, vector_size

COMPONENTS = 4
#: The longest vector: its covariance (8 bytes an entry) is held by the driver and summed by rows.
MAX_SIZE = 4096
#: Quadrature points on the half circle, refinements at most, and the residual aimed at (times the norm of the matrix).
POINTS, ROUNDS, RESIDUAL = 16, 60, 4e-15
#: Eigenvalues below this share of the greatest count as zero: their components have no direction of their own.
ZERO = 1e-12


# ---- eigenvalues of a symmetric matrix by contour integration -----------------
class Inertia:
    """Counts of the eigenvalues of a symmetric matrix above given points, by
    Sylvester's law: pivots of the shifted matrix, which Householder
    reflections bring to tridiagonal form once (a congruence)."""

    def __init__(self, a: np.ndarray):
        a, n = a.astype(np.float64).copy(), len(a)
        for k in range(n - 2):
            x = a[k + 1:, k]
            length = np.linalg.norm(x)
            if length and np.abs(x[1:]).max() > 0:
                v = x.copy()
                v[0] += np.copysign(length, v[0])
                v /= np.linalg.norm(v)
                rest = a[k + 1:, k + 1:]
                w = rest @ v
                w -= (w @ v) * v
                rest -= 2 * (np.outer(v, w) + np.outer(w, v))
                a[k + 1, k] = -np.copysign(length, x[0])
        self.diagonal, self.off2 = np.diagonal(a).copy(), np.diagonal(a, -1) ** 2
        self.tiny = np.finfo(float).tiny / np.finfo(float).eps

    def above(self, x) -> np.ndarray | int:
        """Eigenvalues greater than ``x`` (a number, or each of an array)."""
        shift = np.asarray(x, np.float64)
        count = np.zeros(shift.shape, np.int64)
        pivot = np.ones(shift.shape)
        for d, e in zip(self.diagonal, np.append(0.0, self.off2)):
            pivot = d - shift - e / pivot
            pivot = np.where(np.abs(pivot) < self.tiny, -self.tiny, pivot)
            count += pivot > 0
        return count if shift.shape else int(count)


def interval_of(inertia: Inertia, bound: float, k: int) -> tuple[float, float, int]:
    """(low, high, eigenvalues within): an interval around the ``k`` greatest
    eigenvalues (more where equal ones straddle its end), all of them between
    -``bound`` and ``bound``.  Inertia counts at 64 points at a time close in
    on the greatest eigenvalue and on the gap that ``low`` halves."""
    def narrow(count: int, low: float, high: float) -> tuple[float, float]:
        """Neighbours of the ``count``-th eigenvalue: at least as many above the first, fewer above the second."""
        while high - low > 1e-10 * bound:
            x = np.linspace(low, high, 66)[1:-1]
            c = inertia.above(x)
            low, high = max([low, *x[c >= count]]), min([high, *x[c < count]])
        return low, high

    bound *= 1 + 1e-9
    top = narrow(1, -bound, bound)[1]
    edge = narrow(k, -bound, top)[0]
    within = inertia.above(edge)
    under = narrow(within + 1, -bound, edge)[1] if within < len(inertia.diagonal) else -bound
    low = (edge + max(under, edge - (top - edge) - bound * 1e-3)) / 2
    return low, top + 0.05 * (top - low), within


def feast(a: np.ndarray, low: float, high: float, within: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``within`` eigenpairs of a symmetric matrix with eigenvalues between
    ``low`` and ``high``, falling.  Raises ArithmeticError where the contour
    doesn't give as many as the inertia counts say."""
    n = len(a)
    block = min(n, max(within + 4, 2 * within))
    y = np.random.default_rng(12).standard_normal((n, block))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    norm = max(np.abs(a).sum(axis=1).max(), 1e-300)
    eye = np.eye(n)
    best = None
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for t, w in zip(angles, weights):
            z = centre + radius * np.exp(1j * t)
            q += w / 2 * (radius * np.exp(1j * t) * np.linalg.solve(z * eye - a, y)).real
        q, _ = np.linalg.qr(q)
        q, _ = np.linalg.qr(q)
        ritz, s = np.linalg.eigh(q.T @ a @ q)
        y = q @ s
        inside = np.flatnonzero((ritz >= low) & (ritz <= high))
        if len(inside) > within:  # spurious Ritz values in the interval: the worst residuals
            r = np.linalg.norm(a @ y[:, inside] - y[:, inside] * ritz[inside], axis=0)
            inside = inside[np.sort(np.argsort(r, kind="stable")[:within])]
        if len(inside) < within:
            continue
        residual = np.linalg.norm(a @ y[:, inside] - y[:, inside] * ritz[inside], axis=0).max() / norm
        values, vectors = ritz[inside][::-1], y[:, inside][:, ::-1]
        if best is None or residual < best[0]:
            best = (residual, values, vectors)
            if residual <= RESIDUAL:
                break
        elif residual < 1e-12:  # no further gain
            break
    if best is None or best[0] > 1e-9:
        raise ArithmeticError(f"fewer than {within} eigenvalues found between {low} and {high}")
    return best[1], best[2]


def top_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues (fewer where the others are zero) of a
    positive semidefinite matrix, falling, and their unit eigenvectors as columns."""
    scale = float(np.trace(a)) if len(a) else 0.0
    if not scale > 0:
        return np.zeros(0), np.zeros((len(a), 0))
    inertia = Inertia(a)
    k = min(k, inertia.above(ZERO * scale))
    low, high, within = interval_of(inertia, float(np.abs(a).sum(axis=1).max()), k)  # Gershgorin's bound
    values, vectors = feast(a, low, high, within)
    if inertia.above(low) != len(values) or inertia.above(high):
        raise ArithmeticError("the interval's inertia disagrees with the components found")
    return values[:k], vectors[:, :k]


# ---- passes over the rows -------------------------------------------------------
def _sums(size: int):
    def run(batches):
        total, n = [0] * size, 0
        for b in batches:
            x = matrix(b.column(0), size)
            # halves of the numbers: no sum of a batch can pass a long
            total = [t + (int(hi) << 32) + int(lo) for t, hi, lo in zip(total, (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([str(v) for v in [n, *total]])], ["i", "v"])

    return run


def _products(size: int, means: np.ndarray, axes: np.ndarray | None):
    width = size if axes is None else axes.shape[1]

    def run(batches):
        g, s = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            x = matrix(b.column(0), size) - means
            x = x if axes is None else x @ axes
            g += x.T @ x
            s += x.sum(axis=0)
        i, j = np.triu_indices(width)
        yield pd_batch(i, j, g[i, j])
        yield pd_batch(np.arange(width), np.full(width, -1), s)

    return run


def pd_batch(i, j, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.DataFrame({"i": np.asarray(i, np.int32), "j": np.asarray(j, np.int32), "v": v}), preserve_index=False)


def covariance(fit: DataFrame, size: int, n: int, means: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the vectors of ``fit``, centred before
    multiplying; with ``axes`` that of their projections.  Each task adds up
    its own products; what tasks emit has the size of the matrix."""
    width = size if axes is None else axes.shape[1]
    rows = fit.mapInArrow(_products(size, means, axes), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    g, s = np.zeros((width, width)), np.zeros(width)
    for r in rows:
        if r.j < 0:
            s[r.i] = r.v
        else:
            g[r.i, r.j] = g[r.j, r.i] = r.v
    return g / n - np.outer(s / n, s / n)  # what rounding left of the centring


def _project(size: int, n: int, sums: list[int], axes: np.ndarray, explained: np.ndarray, error: float, kind: pa.DataType):
    means = np.array([s / n for s in sums]) if n else np.zeros(size)
    widest = max((abs(s) for s in sums), default=0)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        k = axes.shape[1]
        for b in batches:
            x = matrix(b.column(1), size)
            reach = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + widest
            if reach * reach * size < 2 ** 62:
                d = n * x - np.array(sums, np.int64)
                deviation = (d * d).sum(axis=1).tolist()
            else:
                deviation = [v if v < 2 ** 63 else None for v in
                             (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x)]
            w = (x - means) @ axes
            rows = len(x)
            cols = [b.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, n), pa.int64()), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n (distinct
    vectors), deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out;
    each other row counts, also when it repeats another or its id is null.  The
    covariance is over the distinct vectors.  Shorter vectors count as padded
    with zeros; ``MAX_SIZE`` entries at most.  Components whose eigenvalue is
    zero (fewer dimensions or distinct vectors than ``components``) have no
    rows; of equal eigenvalues any orthogonal vectors are taken.  A deviation
    beyond a long is null.  An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = vectors.schema[vec_id].dataType
    rows = vectors.where(usable(vector)).select(F.col(vec_id).alias("vec_id"), on_grid(vector).alias("x"))
    size = vector_size(rows)
    if size > MAX_SIZE:
        raise ValueError(f"vectors of more than {MAX_SIZE} entries")
    fit = materialise(rows.select(_padded("x", size).alias("x")).distinct(), "whitening-fit")
    got = {r.i: int(r.v) for r in fit.mapInArrow(_sums(size), "i int, v string")
           .groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    n, sums = got.get(-1, 0), [got.get(i, 0) for i in range(size)]
    means = np.array([s / n for s in sums]) if n else np.zeros(size)
    v = covariance(fit, size, n, means) if n else np.zeros((size, size))
    values, axes = top_components(v, components)
    scaled = axes / np.sqrt(values)
    error = 0.0
    if len(values):
        error = float(np.abs(covariance(fit, size, n, means, scaled) - np.eye(len(values))).max())
    explained = values / np.trace(v) if len(values) else values
    return rows.mapInArrow(
        _project(size, n, sums, scaled, explained, error, to_arrow_type(kind)),
        f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _padded(x: str, size: int):
    return F.when(F.size(x) == size, F.col(x)).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x))))


def whitening_report(vectors: DataFrame) -> DataFrame:
    """``whiten`` with four components."""
    return whiten(vectors)
