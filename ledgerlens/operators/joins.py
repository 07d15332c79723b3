"""Joins of the ledger model.

Factor tables are reduced to one row per month before they are broadcast, so
the calendar bounds them whatever the ledger size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import month_key
from ledgerlens.schema import FACTORS


def monthly(df: DataFrame) -> DataFrame:
    """``df`` with one row for each ``month``, for a broadcast: a DATE column
    has under 120,000 months, so the side stays below 10 MB whatever is read."""
    return F.broadcast(df.dropDuplicates(["month"]))


def factor_columns(df: DataFrame) -> list[str]:
    return [f for f in FACTORS if f in df.columns]


def attach_factors(ledger: DataFrame, factors: DataFrame, date_col: str = "order_date") -> DataFrame:
    """Ledger LEFT JOIN monthly factors on the month of ``date_col``.

    D1: when the ledger already carries a factor column, its own value wins
    and the stored month value fills its gaps (``coalesce``), instead of
    both copies vanishing.  Row count of the ledger is preserved because the
    factor table is unique by month."""
    facs = factor_columns(factors)
    right = monthly(factors.select("month", *[F.col(f).alias(f"_f_{f}") for f in facs])).withColumnRenamed("month", "_fm")
    left = ledger.withColumn("_lm", month_key(date_col))
    j = left.join(right, left["_lm"] == right["_fm"], "left")
    out = []
    for c in ledger.columns:
        if c in facs:
            out.append(F.coalesce(F.col(c), F.col(f"_f_{c}")).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"_f_{f}").alias(f) for f in facs if f not in ledger.columns]
    return j.select(*out)


def upsert_factors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join on month; the new value wins, the old one is kept
    where the new one is NULL; sorted by month."""
    facs = sorted(set(factor_columns(existing)) | set(factor_columns(new)),
                  key=FACTORS.index)
    e = existing.select(F.col("month").alias("_m"),
                        *[F.col(f).alias(f"_o_{f}") for f in factor_columns(existing)])
    n = new.select(F.col("month").alias("_n"),
                   *[F.col(f).alias(f"_n_{f}") for f in factor_columns(new)])
    j = e.join(n, e["_m"] == n["_n"], "full")
    cols = [F.coalesce("_n", "_m").alias("month")]
    for f in facs:
        parts = [F.col(f"_n_{f}")] if f in new.columns else []
        parts += [F.col(f"_o_{f}")] if f in existing.columns else []
        cols.append((F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(f))
    return j.select(*cols)


def replace_month(stored: DataFrame, month, values: dict[str, float]) -> DataFrame:
    """Drop the row of ``month`` and append the new row; factors not
    given become NULL (the whole month row is replaced)."""
    m = F.to_date(F.lit(str(month)))
    facs = factor_columns(stored)
    row = stored.sparkSession.range(1).select(
        m.alias("month"),
        *[F.lit(values.get(f)).cast("double").alias(f) for f in facs])
    return stored.where(F.col("month") != m).unionByName(row)


def combine_factor_files(parsed: list[DataFrame]) -> DataFrame:
    """Chained full outer join of per-factor monthly frames on month."""
    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, "month", "full")
    return reduce(step, parsed)


def factors_for_months(rows: DataFrame, factors: DataFrame, month_col: str = "month") -> DataFrame:
    """Each row gets the factor row of its month when that month is
    stored; an absent month takes the whole latest stored row (D10).

    The latest row is one bounded aggregate (six numbers) read as literals,
    so the join stays a broadcast equi-join with no cross product."""
    facs = factor_columns(factors)
    last = factors.agg(F.max_by(F.struct(*facs), F.col("month")).alias("_last")).first()["_last"]
    right = monthly(factors.select("month", F.lit(True).alias("_hit"),
                                   *[F.col(f).alias(f"_f_{f}") for f in facs])).withColumnRenamed("month", "_fm")
    j = rows.join(right, rows[month_col] == right["_fm"], "left")
    fallback = {f: (None if last is None else last[f]) for f in facs}
    return j.select(
        *[F.col(c) for c in rows.columns],
        *[F.when(F.col("_hit"), F.col(f"_f_{f}"))
           .otherwise(F.lit(fallback[f]).cast("double")).alias(f) for f in facs])
