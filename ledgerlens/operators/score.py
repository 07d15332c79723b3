"""Scoring (M10, P10, P13, P14) as plain Catalyst projections.

The fitted model becomes one arithmetic expression per target (intercept +
weights x imputed numerics + literal-map lookups for one-hot levels), so
scoring is a narrow projection inside whole-stage codegen with no Python
and no shuffle, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import calendar_features
from ledgerlens.operators.model import LinearModel
from ledgerlens.schema import ACTUAL_COL, DATE_FEATURES, MODEL_USED_COL, PRED_COL, TARGETS


def with_date_features(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """P7/P8 for scoring input: the eleven date features from the date."""
    feats = calendar_features(date_col)
    return df.withColumns({k: v for k, v in feats.items() if k in DATE_FEATURES})


def score(model: LinearModel, df: DataFrame, date_col: str = "order_date",
          keep: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """Predictions of the chosen model per target, rounded to 4 dp,
    with the model name used; targets the model lacks give NULL.  Rows
    without a date are dropped (D17).  P14: predicted gross profit =
    predicted revenue - predicted COGS with NULL as 0."""
    df = model.prepare(with_date_features(df.where(F.col(date_col).isNotNull()), date_col))
    out = {}
    for t in TARGETS:
        if t in model.targets:
            algo = model.best.get(t, "ridge")
            pred = model.prepared_prediction(algo, t)
            out[PRED_COL[t]] = pred if digits is None else F.round(pred, digits)
            out[MODEL_USED_COL[t]] = F.lit(algo)
        else:
            out[PRED_COL[t]] = F.lit(None).cast("double")
            out[MODEL_USED_COL[t]] = F.lit(None).cast("string")
    scored = df.withColumns(out)
    gp = (F.coalesce(F.col(PRED_COL["total_revenue"]), F.lit(0.0))
          - F.coalesce(F.col(PRED_COL["cogs"]), F.lit(0.0)))
    gp = gp if digits is None else F.round(gp, digits)
    scored = scored.withColumn("predicted_gross_profit", gp).drop(*model.helper_columns())
    if keep is not None:
        scored = scored.select(*keep, *PRED_COL.values(), "predicted_gross_profit",
                               *MODEL_USED_COL.values())
    return scored


def actuals(df: DataFrame) -> DataFrame:
    """P13 (D14): ``actual_*`` copies of revenue, COGS, SG&A and gross profit
    (derived as revenue - COGS when the ledger has no gross profit)."""
    cols = df.columns
    gp = (F.col("gross_profit").cast("double") if "gross_profit" in cols else
          F.col("total_revenue").cast("double") - F.col("cogs").cast("double")
          if {"total_revenue", "cogs"} <= set(cols) else F.lit(None).cast("double"))
    src = {"total_revenue": None, "cogs": None, "sga": None}
    new = {ACTUAL_COL[k]: (F.col(k).cast("double") if k in cols else F.lit(None).cast("double"))
           for k in src}
    new[ACTUAL_COL["gross_profit"]] = gp
    return df.withColumns(new)
