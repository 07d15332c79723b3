"""Ledger ingest: CSV read (S1), cleaning for training (S2) and for scoring
(S3), alias renames (P9).

The CSV is read with every column as text; one aggregate finds the empty
columns; all conversion is ``try_cast``-based column expressions, so bad
values become NULL and nothing raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.dates import date_from_year_mo, parse_ledger_date
from ledgerlens.functions.once import select_once
from ledgerlens.functions.text import clean_category, missing_to_null, to_number
from ledgerlens.schema import DIMS, TARGETS, clean_name
from ledgerlens.shared import materialise
from ledgerlens.sources import quoted_csv

_UNNAMED = "_c"


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV -> text columns with clean names.

    Headers are trimmed; unnamed columns dropped; missing tokens (blank, NA,
    N/A, NaN, null, None) become NULL; all-NULL columns and rows dropped.
    Without an ``id`` column, ``row_no`` records file order (file, place in
    the file; see ``file_order``) for the first/latest-row rules."""
    raw = read_csv_text(spark, path)
    keep = [c for c in raw.columns
            if c.strip() and c != "_at" and not (c.startswith(_UNNAMED) and c[len(_UNNAMED):].isdigit())]
    ordered = "row_no" not in [clean_name(c) for c in keep]
    df = raw.select(*[missing_to_null(F.col(f"`{c}`")).alias(clean_name(c)) for c in keep],
                    *([(F.col("_at") if "_at" in raw.columns else file_order(raw)).alias("row_no")] if ordered else []))
    df = materialise(df, "ledger-text")  # read for its empty columns, then for its rows: the files are parsed once
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    full = [c for c in df.columns if counts[c] > 0]
    return df.select(*full).dropna(how="all", subset=[c for c in full if not (ordered and c == "row_no")])


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as text columns.  Files without any quote are read line by
    line; others by records (``quoted_csv``), so that commas, doubled quotes
    and line ends within fields stay, at no loss of parallel reading."""
    if quoted_csv.has_quotes(spark, path):
        return quoted_csv.read_quoted_csv(spark, path)
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def file_order(df: DataFrame):
    """A sortable column of the rows' order in their files: path, start of the
    split, place in the split (which depends on how splits are dealt only
    within a split's task).  Frames that read no files count by task and row."""
    place = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), place.alias("place"))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place.alias("place"))


def rename_aliases(df: DataFrame) -> DataFrame:
    """Raw / API column names -> clean names."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def _numeric(df: DataFrame, c: str):
    t = df.schema[c].dataType
    if isinstance(t, T.NumericType):
        d = F.col(c).cast("double")
        return F.when(F.isnan(d), None).otherwise(d)
    return to_number(c)


def clean_ledger(df: DataFrame, for_training: bool = True) -> DataFrame:
    """S2 / S3 (one cleaner, D7): categoricals trimmed with missing -> NULL;
    ``order_date`` parsed from any ledger format, or built from Year + Mo
    when there is no date column (P5); every other column numeric with bad
    values -> NULL (P1).  Rows without a date are dropped (D17; ``dropped_rows`` counts
    them); for training also rows missing any present target (P19)."""
    df = rename_aliases(df)
    cols = {}
    for c in df.columns:
        if c in DIMS:
            cols[c] = clean_category(c)
        elif c == "order_date":
            t = df.schema[c].dataType
            cols[c] = F.col(c) if isinstance(t, T.DateType) else parse_ledger_date(c)
        elif c in ("row_no", "order_id", "line_no"):
            cols[c] = F.col(c) if isinstance(df.schema[c].dataType, (T.IntegralType, T.StructType)) else \
                F.col(c).cast("string").try_cast("double").try_cast("long")
        else:
            cols[c] = _numeric(df, c)
    out = select_once(df, [e.alias(c) for c, e in cols.items()])  # the rows are filtered by parsed values
    if "order_date" not in out.columns and {"year_raw", "mo_raw"} <= set(out.columns):
        out = out.withColumn("order_date", date_from_year_mo("year_raw", "mo_raw"))
    if "order_date" not in out.columns:
        raise ValueError("ledger has no 'Order Date' (or Year + Mo) column")
    need = ["order_date"] + ([t for t in TARGETS if t in out.columns] if for_training else [])
    return out.dropna(subset=need)


def dropped_rows(raw_rows: int, clean: DataFrame) -> int:
    """Rows of a raw ledger (their count) that the cleaned one lacks."""
    return raw_rows - clean.count()
