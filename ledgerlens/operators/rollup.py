"""Daily roll-up of the ledger (A1, A2), first-row-per-month (A12) and the
forward/backward fill of factors (J2, W1, W2).

The fill runs on the *month* grain: within a month every day carries the
same factor row, so filling the distinct months (at most 12 per year) and
joining back gives the day-level answer without an un-partitioned window
over ledger-sized input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import calendar_features, month_key
from ledgerlens.operators.joins import factor_columns, monthly
from ledgerlens.schema import COSTS, DIMS, TARGETS
from ledgerlens.shared import materialise


def daily_rollup(ledger: DataFrame, factors: DataFrame | None = None,
                 date_col: str = "order_date") -> DataFrame:
    """A1: one row per order date.  Costs and targets are summed (all-NULL
    sums are 0, as pandas), categoricals take their mode (ties -> smallest
    value, all-NULL -> NULL), the eleven date features are derived from the
    key.  With ``factors`` the monthly factors are attached and gaps filled
    forward then backward in date order.  Rows without a date are left out.

    Sums and value counts come from one pass over the ledger, as hash
    aggregates with a map-side combine, so a date holding a third of the rows
    is combined in every task first.  The days (bounded by the calendar) are
    written once: whatever reads them doesn't read the ledger again."""
    sums = [c for c in COSTS + TARGETS if c in ledger.columns]
    dims = [c for c in DIMS if c in ledger.columns]
    dated = ledger.where(F.col(date_col).isNotNull()).withColumn("order_date", F.col(date_col))
    daily = _counts(dated, ["order_date"], dims, sums).groupBy("order_date").agg(
        *[F.coalesce(F.sum(f"_s_{c}"), F.lit(0.0)).alias(c) for c in sums], *_best(dims))
    daily = materialise(daily, "days").withColumns(calendar_features("order_date"))
    if factors is not None and factor_columns(factors):
        daily = _filled(daily, factors, "order_date")
    return daily


def _counts(df: DataFrame, keys: list[str], cols: list[str], sums: list[str] = ()) -> DataFrame:
    """(keys, _c, _v, _n): the row count of each value of each column; with
    ``sums`` (at the value ``_c`` NULL) also their sums ``_s_*`` over the group."""
    types = {c: df.schema[c].dataType for c in sums}
    item = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v"),
                     *[F.lit(None).cast(t).alias(f"_s_{s}") for s, t in types.items()]) for c in cols]
    if sums:
        item.insert(0, F.struct(F.lit(None).cast("string").alias("_c"), F.lit(None).cast("string").alias("_v"),
                                *[F.col(s).alias(f"_s_{s}") for s in sums]))
    return (df.select(*keys, F.explode(F.array(*item)).alias("_x")).groupBy(*keys, "_x._c", "_x._v")
            .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_x._s_{s}").alias(f"_s_{s}") for s in sums]))


def _best(cols: list[str]) -> list:
    return [F.min_by(F.when(F.col("_c") == c, F.col("_v")), F.when(
        (F.col("_c") == c) & F.col("_v").isNotNull(), F.struct(-F.col("_n"), F.col("_v")))).alias(c) for c in cols]


def modes(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """A2 / M2: one row per group of ``keys`` with the commonest non-NULL value
    of each column (ties -> smallest; NULL without one).  Counts per (group,
    value) come first, so no buffer holds a group's values."""
    return _counts(df, keys, cols).groupBy(*keys).agg(*_best(cols))


def segment_rollup(ledger: DataFrame, factors: DataFrame | None = None, date_col: str = "order_date") -> DataFrame:
    """One row per order date and segment (the five dimensions as they
    are, NULL a value), with the totals of the costs and targets that the
    ledger has (it may have none), the date features and filled factors."""
    sums = [c for c in COSTS + TARGETS if c in ledger.columns]
    dims = [c for c in DIMS if c in ledger.columns]
    keyed = ledger.where(F.col(date_col).isNotNull()).select(F.col(date_col).alias("order_date"), *dims, *sums)
    out = keyed.groupBy("order_date", *dims).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums]) if sums else keyed.distinct()
    out = out.withColumns(calendar_features("order_date"))
    return attach_filled_factors(out, factors) if factors is not None and factor_columns(factors) else out


def fill_factor_months(months: DataFrame, factors: DataFrame) -> DataFrame:
    """W1 + W2 on the month grain: months LEFT JOIN factors, then forward
    fill, then backward fill of leading gaps.  ``months`` holds distinct
    month starts (bounded by the calendar), so the ordered window is small."""
    facs = factor_columns(factors)
    j = months.join(factors.select("month", *facs), "month", "left")
    fwd = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.orderBy("month").rowsBetween(0, Window.unboundedFollowing)
    return j.coalesce(1).select(
        "month",
        *[F.coalesce(F.last(f, ignorenulls=True).over(fwd),
                     F.first(f, ignorenulls=True).over(bwd)).alias(f) for f in facs])


def attach_filled_factors(daily: DataFrame, factors: DataFrame,
                          date_col: str = "order_date") -> DataFrame:
    """Attach month factors to a daily table and fill the gaps.  The table
    is read twice (its months, its rows), so it is written once."""
    return _filled(materialise(daily, "days"), factors, date_col)


def _filled(daily: DataFrame, factors: DataFrame, date_col: str) -> DataFrame:
    months = daily.select(month_key(date_col).alias("month")).distinct()
    filled = fill_factor_months(months, factors)
    facs = factor_columns(factors)
    filled = monthly(filled.select("month", *[F.col(f).alias(f"_f_{f}") for f in facs])).withColumnRenamed("month", "_fm")
    j = daily.join(filled, month_key(date_col) == F.col("_fm"), "left")
    keep = [c for c in daily.columns if c not in facs]
    return j.select(*keep, *[F.col(f"_f_{f}").alias(f) for f in facs])


def first_row_per_month(df: DataFrame, order_cols: list[str], date_col: str = "month",
                        value_cols: list[str] | None = None) -> DataFrame:
    """One row per month: the first row by ``order_cols`` (the source
    row number where present, D4), keeping ``value_cols``.  ``min_by`` is a
    partial aggregate, so a crowded month is combined map-side."""
    value_cols = value_cols or [c for c in df.columns if c != date_col and c not in order_cols]
    key = F.struct(*[F.col(c) for c in order_cols])
    return (df.where(F.col(date_col).isNotNull())
            .groupBy(date_col)
            .agg(F.min_by(F.struct(*[F.col(c) for c in value_cols]), key).alias("_r"))
            .select(date_col, *[F.col(f"_r.{c}").alias(c) for c in value_cols]))
