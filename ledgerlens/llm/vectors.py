"""Embeddings as whole numbers, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the grid in one unit.
GRID = 256


def usable(vector: str = "embedding") -> Column:
    """Neither null nor with a null or non-finite entry."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))


def on_grid(vector: str = "embedding") -> Column:
    """floor(256 * c) of each entry, as long (saturated beyond it)."""
    return F.transform(vector, lambda c: F.floor(GRID * c.cast("double")).cast("long"))


def vector_size(rows: DataFrame, vector: str = "x") -> int:
    """The length of the longest vector (0 for an empty table); shorter ones
    count as padded with zeros."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column, size: int) -> np.ndarray:
    """An Arrow list column, or a pandas column of lists, of longs as a matrix of int64."""
    if isinstance(column, pa.Array):
        if len(column) and (np.diff(column.offsets.to_numpy()) == size).all():
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.int64, copy=False)
        column = column.to_pylist()
    out = np.zeros((len(column), size), np.int64)
    for k, v in enumerate(column):
        out[k, :len(v)] = v
    return out
