"""Text-to-number and text-cleaning expressions (P1, P2, missing tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.schema import MISSING_TOKENS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c) -> Column:
    """Blank and the usual missing tokens (NA, N/A, NaN, null, None) -> NULL."""
    s = F.trim(_col(c).cast("string"))
    return F.when(F.upper(s).isin(*MISSING_TOKENS), F.lit(None).cast("string")).otherwise(s)


def _nan_to_null(d: Column) -> Column:
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def to_number(c) -> Column:
    """Ledger money text -> DOUBLE: drop ``$`` and ``,``, trim, cast; bad -> NULL.

    Numeric input is passed through (NaN normalised to NULL)."""
    s = F.trim(F.regexp_replace(_col(c).cast("string"), r"[$,]", ""))
    return _nan_to_null(s.try_cast("double"))


def to_factor_number(c) -> Column:
    """Factor value text -> DOUBLE: drop ``$ , %`` and all whitespace first."""
    s = F.regexp_replace(_col(c).cast("string"), r"[$,%\s]", "")
    return _nan_to_null(s.try_cast("double"))


def clean_category(c) -> Column:
    """Categorical text: trimmed, missing tokens -> NULL (never the text 'nan')."""
    return missing_to_null(c)


def numeric_or_keep(df: DataFrame, cols: list[str]) -> DataFrame:
    """Convert a text column to DOUBLE only when every non-missing value
    converts; otherwise keep it as text.  One aggregate decides all columns."""
    if not cols:
        return df
    checks = []
    for c in cols:
        v = missing_to_null(c)
        checks.append((F.count(v) - F.count(to_number(v))).alias(c))
    row = df.agg(*checks).first()
    convert = [c for c in cols if row[c] == 0]
    return df.withColumns({c: to_number(missing_to_null(c)) for c in convert}) if convert else df
