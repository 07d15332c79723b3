"""Per-company factor store (S9, S10): one parquet part per company in a
store with optimistic commits (``manifest``).  Saving replaces only that
company's part; loading reads only it, and one version of it whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import FACTORS
from ledgerlens.sources.manifest import Store


def _row(df: DataFrame) -> DataFrame:
    return df.select("month", *[F.col(f).cast("double") if f in df.columns else
                                F.lit(None).cast("double").alias(f) for f in FACTORS])


def save_company_factors(df: DataFrame, path: str, company_id) -> None:
    """Whole-table replace of one company's factors."""
    Store(df.sparkSession, path).commit(str(company_id), lambda old: _row(df))


def update_company_factors(spark: SparkSession, path: str, company_id,
                           change: Callable[[DataFrame | None], DataFrame]) -> None:
    """``change(stored factors or None)`` replaces them; it runs again on
    the newer ones when another writer was first, so no update is lost."""
    Store(spark, path).commit(str(company_id), lambda old: _row(change(old)))


def load_company_factors(spark: SparkSession, path: str, company_id) -> DataFrame | None:
    """One company's stored factors (None when the store or the
    company's part is absent or empty)."""
    d = Store(spark, path).read(str(company_id))
    return d if d is not None and not d.isEmpty() else None


def company_factor_rows(spark: SparkSession, path: str, company_id) -> DataFrame | None:
    """The stored table as rows ordered by month."""
    d = load_company_factors(spark, path, company_id)
    return None if d is None else d.orderBy("month")
