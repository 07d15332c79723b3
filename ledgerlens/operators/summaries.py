"""Summaries: region roll-up (A5), forecast and batch totals (A6, A7),
date coverage (A15, A16), coverage report (P21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.joins import factor_columns


def region_key(c: str = "region"):
    """NULL or blank region -> 'Unknown'."""
    return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("Unknown"))


def region_summary(df: DataFrame, revenue: str = "total_revenue", cogs: str = "cogs",
                   sga: str = "sga", extra: dict | None = None) -> DataFrame:
    """A5: revenue, COGS, SG&A (NULL -> 0, 2 dp) and row count per region,
    largest revenue first.  One partial+final hash aggregate."""
    return (df.groupBy(region_key().alias("region"))
            .agg(F.round(F.sum(F.coalesce(F.col(revenue), F.lit(0.0))), 2).alias("total_revenue"),
                 F.round(F.sum(F.coalesce(F.col(cogs), F.lit(0.0))), 2).alias("total_cogs"),
                 F.round(F.sum(F.coalesce(F.col(sga), F.lit(0.0))), 2).alias("total_sga"),
                 F.count(F.lit(1)).alias("row_count"),
                 *[e.alias(k) for k, e in (extra or {}).items()])
            .orderBy(F.desc("total_revenue"), "region"))


def date_range(df: DataFrame, c: str = "order_date") -> DataFrame:
    """Min / max date and row count of a table."""
    return df.agg(F.min(c).alias("date_range_start"), F.max(c).alias("date_range_end"),
                  F.count(F.lit(1)).alias("row_count"))


def factor_coverage(joined: DataFrame) -> DataFrame:
    """For each factor column after a factor join, whether any row got a
    value and how many did (one aggregate for all factors)."""
    facs = factor_columns(joined)
    if not facs:
        return joined.sparkSession.createDataFrame([], "factor string, matched boolean, n_rows long")
    row = joined.agg(*[F.count(f).alias(f) for f in facs])
    stack = ", ".join(f"'{f}', `{f}`" for f in facs)
    return (row.selectExpr(f"stack({len(facs)}, {stack}) as (factor, n_rows)")
            .select("factor", (F.col("n_rows") > 0).alias("matched"), "n_rows"))
