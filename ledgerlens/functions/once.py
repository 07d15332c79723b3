"""Columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_once(df: DataFrame, cols: list[Column]) -> DataFrame:
    """``df.select(*cols)`` as generated rows.  A filter on a plain projection is
    pushed below it and computes its expressions again; these are computed once."""
    return df.select(F.inline(F.array(F.struct(*cols))))
