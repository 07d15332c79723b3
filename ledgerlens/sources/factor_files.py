"""Factor inputs: single-factor files (S5), stored factor tables (S6, S7),
factors inside a wide ledger (S8) and the JSON payload (S11).

Header detection looks only at column *names* (driver-side, no data);
everything else is column expressions plus the per-month first-row
aggregate, so the output is always unique by month (D16) and safe to
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import month_key, parse_factor_date
from ledgerlens.functions.once import select_once
from ledgerlens.functions.text import to_factor_number
from ledgerlens.operators.rollup import first_row_per_month
from ledgerlens.sources.ledger_csv import file_order
from ledgerlens.schema import (FACTOR_LABELS, FACTOR_SIGNATURES, FACTORS,
                               LEDGER_FACTOR_DATE_COLUMNS, STORED_FACTOR_DATE_COLUMNS)


def _order_col(df: DataFrame) -> DataFrame:
    if "_src_row" in df.columns:
        return df
    return df.withColumn("_src_row", file_order(df))


def detect_factor(columns: list[str]) -> tuple[str, str, str] | None:
    """(factor, date column, value column) from a file's headers: factors in
    table order, candidates in order, case-insensitive; None if no match."""
    lower = {str(c).strip().lower(): c for c in columns}
    for factor, (dates, values) in FACTOR_SIGNATURES.items():
        dc = next((lower[c] for c in dates if c in lower), None)
        vc = next((lower[c] for c in values if c in lower), None)
        if dc is not None and vc is not None:
            return factor, dc, vc
    return None


def read_factor_file(df: DataFrame, filename: str = "") -> DataFrame:
    """A two-column factor file -> ``month, <factor>``: dates parsed
    (``Mon-YY`` first), values scrubbed of ``$ , %`` and blanks, NULLs
    dropped, month start, first row per month (file order), sorted."""
    hit = detect_factor(df.columns)
    if hit is None:
        raise ValueError(f"cannot detect the factor of {filename!r}; columns {df.columns}")
    factor, dc, vc = hit
    d = select_once(_order_col(df), [month_key(parse_factor_date(F.col(f"`{dc}`"))).alias("month"),
                                     to_factor_number(F.col(f"`{vc}`")).alias(factor), F.col("_src_row")])
    d = d.dropna(subset=["month", factor])
    return first_row_per_month(d, ["_src_row"], "month", [factor]).orderBy("month")


def combine_factor_files(files: dict[str, DataFrame], failed: dict[str, str] | None = None) -> DataFrame:
    """Q6: at most six files, one factor each (a second file for a factor is
    an error), chained full outer join on month (J3), sorted.

    With ``failed`` a file that can't be read is passed over and its reason
    noted there under its name; without any readable file it is an error."""
    from ledgerlens.operators.joins import combine_factor_files as _combine
    if len(files) > 6:
        raise ValueError("at most six factor files")
    parsed, seen = [], set()
    for name, df in files.items():
        try:
            p = read_factor_file(df, name)
        except ValueError as e:
            if failed is None:
                raise
            failed[name] = str(e)
            continue
        f = [c for c in p.columns if c != "month"][0]
        if f in seen:
            raise ValueError(f"factor {FACTOR_LABELS[f]} uploaded twice")
        seen.add(f)
        parsed.append(p)
    if not parsed:
        raise ValueError(f"no factor file can be read: {failed}")
    out = _combine(parsed)
    return out.select("month", *[f for f in FACTORS if f in out.columns]).orderBy("month")


def read_stored_factors(df: DataFrame) -> DataFrame:
    """Stored factor table -> month + present factors, one row per month
    (first in source order), NULL months dropped."""
    dc = next((c for c in STORED_FACTOR_DATE_COLUMNS if c in df.columns), None)
    if dc is None:
        raise ValueError("no date column in the stored factor table")
    facs = [c for c in df.columns if c in FACTOR_LABELS.values()]
    d = select_once(_order_col(df), [month_key(parse_factor_date(F.col(f"`{dc}`"))).alias("month"),
                                     *[to_factor_number(F.col(f"`{c}`")).alias(c.lower()) for c in facs], F.col("_src_row")])
    return first_row_per_month(d, ["_src_row"], "month", [c.lower() for c in facs])


def stored_factors_monthly(df: DataFrame) -> DataFrame:
    """As S6, keeping only factors with at least one value (P20), sorted
    by month; an error when no factor has any value."""
    d = read_stored_factors(df)
    facs = [c for c in FACTORS if c in d.columns]
    counts = d.agg(*[F.count(c).alias(c) for c in facs]).first() if facs else {}
    keep = [c for c in facs if counts[c] > 0]
    if not keep:
        raise ValueError("no factor column holds a value")
    return d.select("month", *keep).orderBy("month")


def extract_factors_from_ledger(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Factor columns (case-insensitive names) and a date column found in
    a wide ledger -> tidy monthly factors.  NULL-only rows are dropped before
    the first row per month is taken (D15).  Returns (frame, factors found)."""
    lower = {str(c).strip().lower(): c for c in df.columns}
    dc = next((lower[c] for c in LEDGER_FACTOR_DATE_COLUMNS if c in lower), None)
    if dc is None:
        raise ValueError("cannot find a date column")
    found = {f: lower[f] for f in FACTORS if f in lower}
    if not found:
        raise ValueError("no factor columns")
    src = _order_col(df)
    d = select_once(src, [month_key(parse_factor_date(F.col(f"`{dc}`").cast("string"))).alias("month"),
                          *[to_factor_number(F.col(f"`{c}`")).alias(f) for f, c in found.items()], F.col("_src_row")])
    d = d.where(F.col("month").isNotNull()).dropna(how="all", subset=list(found))
    return first_row_per_month(d, ["_src_row"], "month", list(found)), list(found)


FACTOR_JSON_SCHEMA = ("struct<rows: array<struct<date: string, CCI: double, CPI: double, "
                      "Oil: double, GDP: double, Unemployment: double, ROI: double>>>")


def factors_from_json(payload: DataFrame, col: str = "payload") -> DataFrame:
    """``{"rows": [{"date": ..., "CCI": ...}, ...]}`` text -> month-start
    factor table; rows with a bad date dropped; first row per month (D16)."""
    parsed = payload.select(F.from_json(F.col(col), FACTOR_JSON_SCHEMA).alias("p"),
                            F.monotonically_increasing_id().alias("_doc"))
    rows = parsed.select("_doc", F.posexplode("p.rows").alias("_pos", "r"))
    d = rows.select(month_key(parse_factor_date(F.col("r.date"))).alias("month"),
                    *[F.col(f"r.{lab}").alias(f) for f, lab in FACTOR_LABELS.items()],
                    "_doc", "_pos")
    return first_row_per_month(d.where(F.col("month").isNotNull()), ["_doc", "_pos"], "month", FACTORS)
