"""The query catalogue behind ``__spark_entry__.queries()``.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
conformed tables of that folder; a few read a bounded value first (the last
ledger date, the groups whose medians need narrowing).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import joins, summaries
from ledgerlens.shared import checkpoint_root, materialise
from ledgerlens.sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("region_summary")
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: ledger LEFT JOIN monthly factors, then revenue, COGS, SG&A
    and row counts by region (J1 + A5)."""
    joined = joins.attach_factors(td.ledger(spark, sf_dir), td.factors(spark, sf_dir))
    return summaries.region_summary(joined, extra={"factor_rows": F.count("cci")})


# ---------------------------------------------------------------------------
# shared inputs and parameters of the catalogue
# ---------------------------------------------------------------------------
from ledgerlens.functions.dates import calendar_features  # noqa: E402
from ledgerlens.operators import correlate, forecast, rollup, whatif  # noqa: E402
from ledgerlens.operators.medians import exact_medians  # noqa: E402
from ledgerlens.operators.whatif import WhatIfState  # noqa: E402
from ledgerlens.schema import COSTS, DIMS, FACTORS, LEDGER_MEASURES, SEGMENT, TARGETS  # noqa: E402

# Rounding: money sums over few rows and medians are compared at 6 dp (the
# inputs carry at most five decimals, so both engines agree there), large
# totals at 2 dp, factors / correlations / metrics at 4 dp.

# what-if parameters (the "current month" is passed in, never read from the clock)
WHATIF_MONTH = "2002-03-01"
WHATIF_VALUES = {"cci": 55.0, "oil": 30.0}
OVERRIDES = {"cci": 50.0, "oil": 0.0, "roi": None}   # zero / None are ignored (P17)
FUTURE_MONTHS = 6
# total order of ledger rows (D4): date, keys, then every other column
LEDGER_ORDER = (["order_date", "order_id", "line_no"] + DIMS + ["total_revenue"] + COSTS
                + ["sga"])


def _joined(spark, sf_dir):
    return joins.attach_factors(td.ledger(spark, sf_dir), td.factors(spark, sf_dir))


def _written_ledger(spark, sf_dir):
    """The ledger's joins done once, for queries that read it several times: the
    numbers of the tables are written, costs and totals are made of them when read."""
    return td.clean_ledger(materialise(td.ledger_lines(spark, sf_dir), "ledger"))


def _r(cols, nd):
    return [F.round(F.col(c), nd).alias(c) for c in cols]


@query("daily_rollup")
def daily_rollup_q(spark, sf_dir):
    """A1 + A2 + P7/P8 + J2 + W1/W2: the model matrix at daily grain."""
    d = rollup.daily_rollup(td.ledger(spark, sf_dir), td.factors(spark, sf_dir))
    feats = calendar_features("order_date")
    return d.select("order_date", *_r(COSTS + TARGETS, 6), *DIMS,
                    *[c for c in feats if not c.endswith(("_sin", "_cos"))],
                    *_r([c for c in feats if c.endswith(("_sin", "_cos"))], 6),
                    *_r(FACTORS, 4))


@query("segment_cost_medians")
def segment_cost_medians_q(spark, sf_dir):
    """A3: exact median of the eight costs per (region, geo, country,
    customer, item_type)."""
    m = forecast.segment_cost_medians(td.ledger(spark, sf_dir))
    return m.select(*SEGMENT, *_r(COSTS, 6))


def _segment_costs(spark, sf_dir):
    """Dates, segments and costs of the ledger, written once: they are read for
    the last date, the sizes of the segments and the medians."""
    lines = materialise(td.ledger_lines(spark, sf_dir).drop("l_orderkey", "l_discount"), "segment-costs")
    return td.clean_ledger(lines.withColumns({"l_orderkey": F.lit(None).cast("long"), "l_discount": F.lit(None).cast("double")})).select("order_date", *SEGMENT, *COSTS)


@query("future_rows")
def future_rows_q(spark, sf_dir):
    """G1-G3 + J6-J8: segments x the six months after the ledger's last
    month, with segment cost medians and month factors (latest-row fallback)."""
    led = _segment_costs(spark, sf_dir)
    last = led.agg(F.max("order_date")).first()[0]
    start = forecast.future_start(last)
    end = start
    for _ in range(FUTURE_MONTHS - 1):
        end = forecast.next_month(end)
    rows = forecast.future_rows(led, td.factors(spark, sf_dir), start, end)
    return rows.select("order_date", *SEGMENT, *_r(COSTS, 6), *_r(FACTORS, 4))


@query("column_medians")
def column_medians_q(spark, sf_dir):
    """A4: exact global medians of the ledger measures and attached factors."""
    cols = LEDGER_MEASURES + FACTORS
    return exact_medians(_joined(spark, sf_dir), [], cols).select(*_r(cols, 4))


@query("factor_first_row_per_month")
def factor_first_row_per_month_q(spark, sf_dir):
    """First ledger row of every order month by the total row order,
    carrying its attached factors (D4, D15)."""
    j = _joined(spark, sf_dir)
    first = rollup.first_row_per_month(j, LEDGER_ORDER, "month", ["order_id", "line_no"] + FACTORS)
    return first.select("month", "order_id", "line_no", *_r(FACTORS, 4))


@query("factor_coverage")
def factor_coverage_q(spark, sf_dir):
    """Which factors matched ledger months after the join, and how often."""
    return summaries.factor_coverage(_joined(spark, sf_dir))


@query("factor_correlation")
def factor_correlation_q(spark, sf_dir):
    """6x6 factor correlation over the stored months."""
    return pipelines.factor_correlation(td.factors(spark, sf_dir))


def _ledger_matrix(spark, sf_dir, **kw):
    return pipelines.ledger_correlation(td.ledger(spark, sf_dir), td.factors(spark, sf_dir), order_cols=LEDGER_ORDER, **kw)


@query("full_correlation")
def full_correlation_q(spark, sf_dir):
    """A10 / Q11: 17x17 matrix of ledger measures and attached factors."""
    return _ledger_matrix(spark, sf_dir)


@query("full_correlation_rows")
def full_correlation_rows_q(spark, sf_dir):
    """A10: the full matrix's row_count, over a ledger with empty rows."""
    led = td.ledger(spark, sf_dir)
    gaps = led.withColumns({c: F.when(F.col("order_id") % 9 == 0, None).otherwise(F.col(c)) for c in LEDGER_MEASURES})
    return pipelines.correlated_rows(gaps, td.factors(spark, sf_dir))


@query("full_correlation_override")
def full_correlation_override_q(spark, sf_dir):
    """P17 + A10: what-if constant overrides before the full matrix."""
    return _ledger_matrix(spark, sf_dir, overrides=OVERRIDES)


@query("cross_correlation")
def cross_correlation_q(spark, sf_dir):
    """11x6 rectangle of ledger measures against factors."""
    return _ledger_matrix(spark, sf_dir, kind="cross")


@query("factor_correlation_append")
def factor_correlation_append_q(spark, sf_dir):
    """Q13: append a row for the given month (given values, medians for the
    rest), then the 6x6 matrix."""
    return pipelines.factor_correlation(td.factors(spark, sf_dir), append=WHATIF_VALUES, append_month=WHATIF_MONTH)


@query("factor_correlation_replace_latest")
def factor_correlation_replace_latest_q(spark, sf_dir):
    """Q14: overwrite the given values in the latest month, then 6x6."""
    return pipelines.factor_correlation(td.factors(spark, sf_dir), replace_latest=WHATIF_VALUES)


@query("cross_correlation_append")
def cross_correlation_append_q(spark, sf_dir):
    """Q15: ledger + factors, one appended row (medians + given values), 11x6."""
    return _ledger_matrix(spark, sf_dir, kind="cross", append=WHATIF_VALUES)


@query("cross_correlation_replace_latest")
def cross_correlation_replace_latest_q(spark, sf_dir):
    """Q16 (D2): given factor values written into the latest ledger row, 11x6."""
    return _ledger_matrix(spark, sf_dir, kind="cross", replace_latest=WHATIF_VALUES)


@query("full_correlation_append")
def full_correlation_append_q(spark, sf_dir):
    """Q17 (D2): appended row, then the full matrix."""
    return _ledger_matrix(spark, sf_dir, append=WHATIF_VALUES)


@query("full_correlation_replace_latest")
def full_correlation_replace_latest_q(spark, sf_dir):
    """Q18 (D2): latest row updated, then the full matrix."""
    return _ledger_matrix(spark, sf_dir, replace_latest=WHATIF_VALUES)


@query("whatif_session")
def whatif_session_q(spark, sf_dir):
    """Q11, Q15-Q18 of one ledger from its stored co-moment state: the base
    matrix, an appended row, a replaced latest row and the cross form."""
    path = f"{checkpoint_root(spark)}/whatif-state-{uuid.uuid4().hex}"
    pipelines.whatif_state(td.ledger(spark, sf_dir), td.factors(spark, sf_dir), order_cols=LEDGER_ORDER).save(path)
    state = WhatIfState.load(spark, path)
    made = {"base": state.matrix(), "append": state.matrix(append=WHATIF_VALUES),
            "replace_latest": state.matrix(replace_latest=WHATIF_VALUES),
            "cross_append": state.matrix(append=WHATIF_VALUES, rows=LEDGER_MEASURES, columns=FACTORS)}
    return reduce(DataFrame.unionByName, [m.withColumn("variant", F.lit(v)) for v, m in made.items()])


@query("latest_row_replaced")
def latest_row_replaced_q(spark, sf_dir):
    """W3 / U4 (D4): how many rows of the ledger, taken twice, carry the
    value written into its one latest row."""
    led = _written_ledger(spark, sf_dir)
    out = whatif.replace_latest(led.unionByName(led), LEDGER_ORDER, {"freight": -1.0})
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("freight") == -1.0).alias("n_changed"))


# ---------------------------------------------------------------------------
# a ledger with gaps: NULL and blank regions, NULL dimensions and costs
# ---------------------------------------------------------------------------
def ledger_with_gaps(spark, sf_dir):
    k = F.col("order_id")
    blank = lambda c, m: F.when(k % m == 0, None).otherwise(F.col(c))
    return td.ledger(spark, sf_dir).withColumns({
        "region": F.when(k % 7 == 0, None).when(k % 7 == 1, F.lit("  ")).otherwise(F.col("region")),
        "geo": blank("geo", 5), "customer": blank("customer", 3), "freight": blank("freight", 4),
        "storage": F.when(F.col("country") == "KENYA", None).otherwise(F.col("storage")), "sga": blank("sga", 6)})


@query("region_summary_gaps")
def region_summary_gaps_q(spark, sf_dir):
    """P15 / A5 over NULL and blank regions and NULL amounts."""
    return summaries.region_summary(ledger_with_gaps(spark, sf_dir))


@query("segment_cost_medians_gaps")
def segment_cost_medians_gaps_q(spark, sf_dir):
    """A3 / J7 where NULL is a value of a segment and costs are missing."""
    return forecast.segment_cost_medians(ledger_with_gaps(spark, sf_dir)).select(*SEGMENT, *_r(COSTS, 6))


@query("dimension_modes_gaps")
def dimension_modes_gaps_q(spark, sf_dir):
    """A2 / M2: the modes of each dimension by month, NULLs left out."""
    return rollup.modes(ledger_with_gaps(spark, sf_dir), ["month"], DIMS)


# ---------------------------------------------------------------------------
# ingest: text ledgers and factor files built from the tables
# ---------------------------------------------------------------------------
from ledgerlens.sources import factor_files, ledger_csv  # noqa: E402

REFRESH_MONTH = "1998-03-01"


def text_ledger(spark, sf_dir):
    """The conformed ledger as raw CSV-like text: headers as in the source
    files, dates in sixteen formats (plus junk), money with ``$`` and padding,
    categorical blanks and missing tokens."""
    led = td.ledger(spark, sf_dir)
    k = F.col("order_id") % 16
    d = F.col("order_date")
    forms = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "dd-MM-yyyy", "MMM yyyy", "yyyy-MM", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm",
             "yyyy/MM/dd", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy", "dd-MMM-yyyy", "M/d/yy", "MM/yyyy", "MMM-yy"]
    date_txt = F.when(F.col("order_id") % 13 == 0, F.lit("not a date"))
    for n, form in enumerate(forms):
        date_txt = date_txt.when(k == n, F.date_format(d, form))
    region_txt = (F.when(F.col("line_no") == 3, F.concat(F.lit("  "), F.col("region"), F.lit(" ")))
                  .when(F.col("line_no") == 5, F.lit("NA")).otherwise(F.col("region")))
    sga_txt = F.when(F.col("order_id") % 17 == 0, F.lit("abc")).otherwise(F.col("sga").cast("string"))
    return led.select(
        F.col("order_id").cast("string").alias("Order Id"),
        F.col("line_no").cast("string").alias("id"),
        date_txt.alias("Order Date"),
        region_txt.alias("Region"),
        F.col("customer").alias("Customer"),
        F.concat(F.lit(" $"), F.col("total_revenue").cast("string"), F.lit(" ")).alias("Total Revenue"),
        F.concat(F.lit("$,"), F.col("cogs").cast("string")).alias("COGS"),
        sga_txt.alias("SG&A"))


@query("clean_ledger_text")
def clean_ledger_text_q(spark, sf_dir):
    """S2 + P1/P3: clean the text ledger for training (dates in any format,
    money scrubbed, missing tokens NULL, rows lacking date or target dropped)."""
    c = ledger_csv.clean_ledger(text_ledger(spark, sf_dir), for_training=True)
    return c.select("order_id", F.col("row_no").alias("line_no"), "order_date", "region", "customer",
                    "total_revenue", "cogs", "sga")


@query("clean_ledger_scoring")
def clean_ledger_scoring_q(spark, sf_dir):
    """S3: the text ledger cleaned for scoring: only rows without a date go."""
    c = ledger_csv.clean_ledger(text_ledger(spark, sf_dir), for_training=False)
    return c.select("order_id", F.col("row_no").alias("line_no"), "order_date", "region", "customer",
                    "total_revenue", "cogs", "sga")


@query("factors_from_two_dates")
def factors_from_two_dates_q(spark, sf_dir):
    """Of two date-like columns the earlier candidate counts."""
    wide = _joined(spark, sf_dir).select(F.add_months("month", 12).alias("Month"), F.col("order_date").alias("Observation_Date"),
                                         F.col("cci").alias("CCI"))
    return factor_files.extract_factors_from_ledger(wide)[0].select("month", *_r(["cci"], 4))


def factor_text_files(spark, sf_dir):
    """Six single-factor files (text) in different header / date / value styles."""
    f = materialise(td.factors(spark, sf_dir), "factors")  # a row per month, read by every file
    m = F.col("month")
    v = lambda c: F.col(c).cast("string")
    return {
        "cci.csv": f.select(F.date_format(m, "MMM-yyyy").alias("observation_date"),
                            F.concat(v("cci"), F.lit(" %")).alias("Consumer Confidence (%)")),
        "cpi.csv": f.select(F.date_format(m, "yyyy-MM-dd").alias("Months"), v("cpi").alias("CPI")),
        "oil.csv": f.select(F.date_format(m, "MMM yyyy").alias("date"),
                            F.concat(F.lit("$"), v("oil")).alias("Oil Price")),
        "gdp.csv": f.select(F.date_format(m, "yyyy-MM").alias("Month"), v("gdp").alias("GDP")),
        "unemployment.csv": f.select(F.date_format(m, "M/d/yyyy").alias("months"),
                                     F.concat(v("unemployment"), F.lit("%")).alias("Unemployment Rate (%)")),
        "roi.csv": f.select(F.date_format(m, "MM/yyyy").alias("months"), v("roi").alias("ROI")),
    }


@query("factor_files_combine")
def factor_files_combine_q(spark, sf_dir):
    """Q6: S5 on six factor files + J3 full outer join on month."""
    out = factor_files.combine_factor_files(factor_text_files(spark, sf_dir))
    return out.select("month", *_r(FACTORS, 4))


def _scratch(spark):
    return f"{checkpoint_root(spark)}/catalog-{uuid.uuid4().hex}"


@query("factor_upload_stored")
def factor_upload_stored_q(spark, sf_dir):
    """Six files and one that can't be read, stored and reread."""
    files = factor_text_files(spark, sf_dir)
    files["roi.csv"] = files["roi.csv"].toDF("nothing", "known")
    rows, _, failed = pipelines.factor_upload(spark, files, _scratch(spark), 7)
    return rows.select("month", *_r(FACTORS, 4), F.lit(",".join(sorted(failed))).alias("failed"))


@query("factor_refresh_stored")
def factor_refresh_stored_q(spark, sf_dir):
    """Q7 then Q9 on a stored table: factors from a wide ledger, one month
    replaced; the date range (A15) of what is stored."""
    store = _scratch(spark)
    wide = _joined(spark, sf_dir).select(F.col("order_date").alias("Order Date"), *[F.col(f).alias(f.upper()) for f in FACTORS])
    pipelines.factors_from_csv(spark, wide, store, 7)
    return pipelines.factor_refresh(spark, store, 7, REFRESH_MONTH, WHATIF_VALUES)[1]


@query("factors_from_ledger_upsert")
def factors_from_ledger_upsert_q(spark, sf_dir):
    """Q7: S8 (factors inside a wide ledger) + J4 upsert into a stored table
    (new value wins, old kept where new is NULL)."""
    wide = _joined(spark, sf_dir).select(F.col("order_date").alias("Order Date"),
                                         *[F.col(f).alias(f.upper()) for f in FACTORS])
    new, _found = factor_files.extract_factors_from_ledger(wide)
    f = td.factors(spark, sf_dir)
    existing = f.select("month", (F.col("cci") * 2).alias("cci"), "cpi",
                        F.when(F.month("month") == 1, None).otherwise(F.col("oil")).alias("oil"),
                        "gdp", "unemployment", "roi")
    return joins.upsert_factors(existing, new).select("month", *_r(FACTORS, 4))


@query("factor_refresh")
def factor_refresh_q(spark, sf_dir):
    """Replace one month's whole row (unspecified factors -> NULL)."""
    out = joins.replace_month(td.factors(spark, sf_dir), REFRESH_MONTH, WHATIF_VALUES)
    return out.select("month", *_r(FACTORS, 4))


@query("factors_from_json")
def factors_from_json_q(spark, sf_dir):
    """Factor JSON payloads (one document per year of stored months)."""
    f = td.factors(spark, sf_dir)
    row = F.struct(F.col("month").cast("string").alias("date"),
                   *[F.col(c).alias(lab) for c, lab in
                     {"cci": "CCI", "cpi": "CPI", "oil": "Oil", "gdp": "GDP",
                      "unemployment": "Unemployment", "roi": "ROI"}.items()])
    docs = (f.groupBy(F.year("month").alias("y"))
            .agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("payload")))
    return factor_files.factors_from_json(docs).select("month", *_r(FACTORS, 4))


# ---------------------------------------------------------------------------
# models: training, scoring and the forecast pipelines
# ---------------------------------------------------------------------------
import re  # noqa: E402

from ledgerlens.operators import model as model_ops  # noqa: E402
from ledgerlens.operators import score as score_ops  # noqa: E402
from ledgerlens.plans import pipelines  # noqa: E402
from ledgerlens.schema import ACTUAL_COL, MODEL_USED_COL, PRED_COL  # noqa: E402


def trained_model(spark, sf_dir):
    """Q1 on the conformed ledger (daily grain, 25 % hash test split)."""
    return pipelines.train(td.ledger(spark, sf_dir), td.factors(spark, sf_dir), name="ledger_daily")


def one_feature_model(daily):
    """OLS of each target on daily raw-material cost, fitted on all days
    (no split): the SQL-checkable model (``regr_slope``/``regr_intercept``)."""
    m, _ = model_ops.train_model(daily, name="raw_material_ols", features=["raw_material"], test_size=0.0)
    m.best = {t: "baseline" for t in m.targets}
    return m, None


#: Coefficients of a fixed model: intercept, raw material, freight, cci, then by region.
#: (Their digits keep predictions off rounding ties, where engines differ by the order of a sum.)
FIXED_COEFS = {"total_revenue": (10.0, [2.0371293, 3.0182957, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0]),
               "cogs": (5.0, [1.0293817, 0.2519283, 0.125, 5.0, 4.0, 3.0, 2.0, 1.0]),
               "sga": (1.0, [0.5103927, 0.4982713, 0.0625, 0.0, 1.0, 0.0, 1.0, 0.0])}
FIXED_MEDIANS = {"raw_material": 100.0, "freight": 50.0, "cci": 40.0}
FIXED_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def fixed_model():
    """A model of given coefficients: every scoring pipeline has an SQL twin with it."""
    m = model_ops.LinearModel("fixed", list(FIXED_COEFS), list(FIXED_MEDIANS), ["region"])
    m.medians, m.means, m.scales = dict(FIXED_MEDIANS), dict.fromkeys(FIXED_MEDIANS, 0.0), dict.fromkeys(FIXED_MEDIANS, 1.0)
    m.modes, m.levels = {"region": "ASIA"}, {"region": FIXED_REGIONS}
    m.coefs = {(a, t): c for t, c in FIXED_COEFS.items() for a in ("ridge", "baseline")}
    m.best = dict.fromkeys(FIXED_COEFS, "ridge")
    return m


def _scored(df, *keys, digits=2):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in PRED_COL.values()], *MODEL_USED_COL.values())


@query("train_metrics")
def train_metrics_q(spark, sf_dir):
    """Hold-out metrics of baseline and ridge per
    target (rows-only: the fit has no SQL twin; unit-tested against numpy)."""
    return trained_model(spark, sf_dir)[1]


@query("train_split_sizes")
def train_split_sizes_q(spark, sf_dir):
    """M6: train / test sizes of the daily model matrix (test = ceil(n/4))."""
    return _split_sizes(spark, sf_dir)


def _split_sizes(spark, sf_dir):
    daily = rollup.daily_rollup(td.ledger(spark, sf_dir))
    s = model_ops._split(daily, ["order_date"], 0.25, 42, True)
    return (s.groupBy(F.when(F.col("_test"), "test").otherwise("train").alias("split"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("model_design_matrix")
def model_design_matrix_q(spark, sf_dir):
    """M1-M4: imputed (median) and standardised (population std) costs plus
    the one-hot region columns of the daily matrix, fitted on all days.
    Freight is blanked on the 15th of each month so imputation is exercised."""
    daily = rollup.daily_rollup(td.ledger(spark, sf_dir))
    daily = daily.withColumn("freight", F.when(F.dayofmonth("order_date") == 15, None)
                             .otherwise(F.col("freight")))
    m, _ = model_ops.train_model(daily, name="design", features=["region"] + COSTS,
                                 targets=["total_revenue"], test_size=0.0)
    cols = daily.columns
    out = [F.round(m.numeric_expr(cols, f), 6).alias(f"z_{f}") for f in m.numeric]
    key = m.category_expr(cols, "region")
    out += [F.when(key == lv, 1.0).otherwise(0.0).alias("oh_region_" + re.sub(r"\W+", "_", lv.lower()))
            for lv in m.levels["region"]]
    return daily.select("order_date", *out)


@query("ols_one_feature_scores")
def ols_one_feature_scores_q(spark, sf_dir):
    """M7 + M10: one-feature OLS per target scored on every day."""
    daily = rollup.daily_rollup(td.ledger(spark, sf_dir))
    m, _ = one_feature_model(daily)
    s = score_ops.score(m, daily)
    return s.select("order_date", *PRED_COL.values(), "predicted_gross_profit")


def _future_end(led):
    last = led.agg(F.max("order_date")).first()[0]
    end = forecast.future_start(last)
    for _ in range(FUTURE_MONTHS - 1):
        end = forecast.next_month(end)
    return end


@query("forecast_batch_checked")
def forecast_batch_checked_q(spark, sf_dir):
    """Q3 with the one-feature model: every ledger row scored with actuals,
    plus segments x six future months (medians + month factors), U1."""
    led = _written_ledger(spark, sf_dir)
    m, _ = one_feature_model(rollup.daily_rollup(led))
    rows, _ = pipelines.forecast_batch(m, led, td.factors(spark, sf_dir), forecast_end=_future_end(led), digits=None, written=True)
    preds = list(PRED_COL.values()) + ["predicted_gross_profit"]
    return rows.select("order_date", "row_type", *pipelines.OUT_DIMS,
                       *[F.round(c, 6).alias(c) for c in ACTUAL_COL.values()],
                       *[F.round(c, 2).alias(c) for c in preds], *MODEL_USED_COL.values())


@query("forecast_batch_checked_totals")
def forecast_batch_checked_totals_q(spark, sf_dir):
    """A7 over the checked batch forecast."""
    led = _written_ledger(spark, sf_dir)
    m, _ = one_feature_model(rollup.daily_rollup(led))
    _, tot = pipelines.forecast_batch(m, led, td.factors(spark, sf_dir), forecast_end=_future_end(led), totals_digits=2, written=True)
    return tot


@query("forecast_batch")
def forecast_batch_q(spark, sf_dir):
    """Q3 with the fixed model: history with actuals + future rows."""
    led = _written_ledger(spark, sf_dir)
    rows, _ = pipelines.forecast_batch(fixed_model(), led, td.factors(spark, sf_dir), forecast_end=_future_end(led), digits=None, written=True)
    return rows.select("order_date", "row_type", *pipelines.OUT_DIMS, *[F.round(c, 6).alias(c) for c in ACTUAL_COL.values()],
                       *[F.round(c, 2).alias(c) for c in [*PRED_COL.values(), "predicted_gross_profit"]], *MODEL_USED_COL.values())


@query("forecast_batch_filtered")
def forecast_batch_filtered_q(spark, sf_dir):
    """Q3 with filters: region ' europe ' (case / blanks ignored), a history
    window, an override, future months from the month after the ledger: A7."""
    led = _written_ledger(spark, sf_dir)
    _, tot = pipelines.forecast_batch(fixed_model(), led, td.factors(spark, sf_dir),
                                      region=" europe ", history_start="1997-01-01", history_end="1999-12-31",
                                      overrides={"cci": 52.0}, forecast_end=_future_end(led), totals_digits=2, digits=None, written=True)
    return tot


def _range(spark, sf_dir):
    led = _segment_costs(spark, sf_dir)
    snap = forecast.segment_cost_medians(led)
    snap = joins.factors_for_months(snap.withColumn("month", F.lit(None).cast("date")), td.factors(spark, sf_dir)).drop("month")
    start = forecast.future_start(led.agg(F.max("order_date")).first()[0])
    end = start
    for _ in range(11):
        end = forecast.next_month(end)
    monthly, totals = pipelines.forecast_range(fixed_model(), start, end, snap, scenario_cols=SEGMENT)
    return monthly, totals


@query("forecast_range")
def forecast_range_q(spark, sf_dir):
    """Q2: monthly forecast over the twelve months after the ledger for every
    segment snapshot (segment cost medians + latest factors as constants)."""
    return _scored(_range(spark, sf_dir)[0], *SEGMENT, "month", "date", digits=4)


@query("forecast_range_totals")
def forecast_range_totals_q(spark, sf_dir):
    """Totals and months of every snapshot's range forecast."""
    totals = _range(spark, sf_dir)[1]
    return totals.select(*SEGMENT, *[F.round(c, 2).alias(c) for c in ("total_revenue", "total_cogs", "total_sga")], "months_count")


@query("forecast_map_regions")
def forecast_map_regions_q(spark, sf_dir):
    """Q4/Q5: score the ledger with month factors, predicted totals by region."""
    return pipelines.forecast_map_batch(fixed_model(), td.ledger(spark, sf_dir), td.factors(spark, sf_dir), digits=None)[1]


@query("forecast_map_posted")
def forecast_map_posted_q(spark, sf_dir):
    """Q4: posted rows without factors, with gaps, by region."""
    return pipelines.forecast_map(fixed_model(), ledger_with_gaps(spark, sf_dir))


@query("forecast_map_rows")
def forecast_map_rows_q(spark, sf_dir):
    """Q5 detail: date, dimensions, predictions and models of every ledger row."""
    return _scored(pipelines.forecast_map_batch(fixed_model(), td.ledger(spark, sf_dir), td.factors(spark, sf_dir), digits=None)[0],
                   "order_date", *DIMS)


@query("model_evaluation")
def model_evaluation_q(spark, sf_dir):
    """MAE, RMSE, R2 and MAPE of the fixed model on ledger rows."""
    return model_ops.evaluate(fixed_model(), _joined(spark, sf_dir))


@query("model_round_trip")
def model_round_trip_q(spark, sf_dir):
    """The fixed model saved, reread and applied by region."""
    path = _scratch(spark)
    model_ops.save_model(fixed_model(), path, spark)
    return pipelines.forecast_map(model_ops.load_model(spark, path, "fixed"), td.ledger(spark, sf_dir))


# ---------------------------------------------------------------------------
# catalogues: batches, uploads, datasets, models
# ---------------------------------------------------------------------------
from ledgerlens.sources import registry  # noqa: E402


@query("batch_subledger_files")
def batch_subledger_files_q(spark, sf_dir):
    """S4 / J9 for every batch: first SUBLEDGER upload with a path."""
    return registry.resolve_batch_files(td.ingestion_batches(spark, sf_dir), td.file_uploads(spark, sf_dir))


@query("dataset_listing")
def dataset_listing_q(spark, sf_dir):
    """Datasets of every user with model counts, newest first."""
    return registry.list_datasets(td.datasets(spark, sf_dir), td.trained_models(spark, sf_dir))


@query("model_positions")
def model_positions_q(spark, sf_dir):
    """Each model's position in its user's newest-first list."""
    return registry.rank_models_per_user(td.trained_models(spark, sf_dir))


@query("register_datasets")
def register_datasets_q(spark, sf_dir):
    """Uploads whose (user, file hash) is already registered are
    reused, the rest are new."""
    c = td.table(spark, sf_dir, "customer")
    cand = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("user_id"),
                    F.sha2(F.when(F.col("c_acctbal") > 0, F.col("c_name"))
                           .otherwise(F.col("c_mktsegment")), 256).alias("file_hash"))
    return registry.register_datasets(td.datasets(spark, sf_dir), cand)


@query("datasets_appended")
def datasets_appended_q(spark, sf_dir):
    """The registry after the append, by user."""
    c = td.table(spark, sf_dir, "customer")
    cand = c.select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_nationkey").cast("long").alias("user_id"),
                    F.sha2(F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(F.col("c_mktsegment")), 256).alias("file_hash"))
    return registry.append_datasets(td.datasets(spark, sf_dir), cand).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_datasets"), F.countDistinct("file_hash").alias("n_files"))


@query("dataset_models")
def dataset_models_q(spark, sf_dir):
    """The newest dataset with models, and its models."""
    ds, ms = td.datasets(spark, sf_dir), td.trained_models(spark, sf_dir)
    top = ms.agg(F.max("dataset_id")).first()[0]
    one = registry.get_dataset(ds, ms, top).select(F.col("id").alias("dataset_id"), "model_count")
    return registry.list_models(ms, dataset_id=top).join(one, "dataset_id").select("dataset_id", "id", "model_name", "model_count")


@query("register_models")
def register_models_q(spark, sf_dir):
    """Candidate model names already taken are rejected (global unique
    names); duplicates among candidates keep the lowest id."""
    m = td.trained_models(spark, sf_dir).withColumn(
        "model_name", F.concat(F.lit("model_"), F.col("dataset_id").cast("string")))
    existing = m.where(F.col("status") == "F")
    cand = m.where(F.col("status") != "F").select("model_name", "id", "dataset_id", "trained_at")
    return registry.register_models(existing, cand)


@query("remove_models")
def remove_models_q(spark, sf_dir):
    """Registry after removing the models of pending orders; model
    count per dataset."""
    m = td.trained_models(spark, sf_dir)
    left = registry.remove_models(m, m.where(F.col("status") == "P"))
    return registry.model_counts(left)


@query("dataset_profile")
def dataset_profile_q(spark, sf_dir):
    """Profile of the conformed ledger."""
    return registry.profile_dataset(td.ledger(spark, sf_dir))


# ---------------------------------------------------------------------------
# quoted CSV ledgers and categoricals with many levels
# ---------------------------------------------------------------------------
from ledgerlens.operators.model import train_model  # noqa: E402


@query("ledger_csv_quoted")
def ledger_csv_quoted_q(spark, sf_dir):
    """The ledger written as CSV files whose customers hold doubled
    quotes, commas and line ends, read back by records and cleaned."""
    name = F.concat(F.lit('Acme "'), F.initcap("customer"), F.lit('", Ltd'),
                    F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("\nSite, "), F.col("line_no").cast("string"))).otherwise(F.lit("")))
    folder = f"{checkpoint_root(spark)}/ledger-csv-{uuid.uuid4().hex}"
    (td.ledger(spark, sf_dir).select(
        F.col("order_id").alias("Order Id"), F.col("line_no").alias("id"), F.date_format("order_date", "yyyy-MM-dd").alias("Order Date"),
        name.alias("Customer"), "region", F.format_number("total_revenue", 4).alias("Total Revenue"),
        F.col("cogs").alias("COGS"), F.col("sga").alias("SG&A"))
     .write.option("header", True).option("escape", '"').option("quoteAll", False).csv(folder))
    c = ledger_csv.clean_ledger(ledger_csv.read_ledger_csv(spark, folder))
    return c.select("order_id", F.col("row_no").alias("line_no"), "order_date", "region", "customer", *_r(["total_revenue", "cogs", "sga"], 6))


@query("train_wide_levels")
def train_wide_levels_q(spark, sf_dir):
    """M4 / M7 / M8 / M10 with a level for every part: baseline and ridge
    (penalty 10) of revenue on labour and part, scored over all rows and
    summed by part with the line number as weight."""
    rows = td.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("customer"), F.col("l_linenumber").alias("line_no"),
        (F.col("l_quantity") * 25 / 2).alias("direct_labor"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_revenue"))
    model, _ = train_model(rows, targets=["total_revenue"], features=["customer", "direct_labor"], test_size=0.0, alphas=[10.0], wide_levels=0)
    scored = model.prepare(rows)
    total = lambda algo: F.round(F.sum(model.prepared_prediction(algo, "total_revenue") * F.col("line_no")), 2)
    return scored.groupBy("customer").agg(F.count(F.lit(1)).alias("row_count"), total("baseline").alias("baseline_total"),
                                          total("ridge").alias("ridge_total"))


# ---------------------------------------------------------------------------
# splits of finer grains, stored factors in whatever header, batch files, orders
# ---------------------------------------------------------------------------
from pyspark.sql import Window  # noqa: E402

from ledgerlens.functions.dates import date_from_year_mo  # noqa: E402
from ledgerlens.functions.text import numeric_or_keep  # noqa: E402
from ledgerlens.operators.split import exact_split  # noqa: E402


@query("train_split_sizes_by_grain")
def train_split_sizes_by_grain_q(spark, sf_dir):
    """Train and test sizes of ledger rows by their keys, of days and
    segments, and of rows by date alone (many rows of one key)."""
    # written once for the three grains: the columns that the splits and the roll-up need
    led = materialise(td.ledger(spark, sf_dir).select("order_id", "line_no", "order_date", *DIMS), "ledger-keys")
    segments = rollup.segment_rollup(led).select("order_date", *DIMS)
    grains = {"row": (led.select("order_id", "line_no"), ["order_id", "line_no"]),
              "day_segment": (segments, ["order_date", *DIMS]),
              "row_by_date": (led.select("order_date", "region"), ["order_date"])}
    sizes = [exact_split(df, keys, 0.25, 42).groupBy("_test").agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(g).alias("grain"), F.when(F.col("_test"), "test").otherwise("train").alias("split"), "n_rows")
             for g, (df, keys) in grains.items()]
    return reduce(DataFrame.unionByName, sizes)


@query("stored_factors_monthly")
def stored_factors_monthly_q(spark, sf_dir):
    """A stored table with labels as headers, ``Mon-YY``
    dates (of this century), repeated months, values with signs and a factor
    without any value; the factors that have values, by month."""
    f = td.factors(spark, sf_dir)
    v = lambda c: F.col(c).cast("string")
    table = f.select(F.date_format("month", "MMM-yy").alias("Order Date"), F.concat(v("cci"), F.lit("%")).alias("CCI"), v("cpi").alias("CPI"),
                     F.concat(F.lit("$"), v("oil")).alias("Oil"), v("gdp").alias("GDP"), F.lit("").alias("Unemployment"), v("roi").alias("ROI"))
    got = factor_files.stored_factors_monthly(table.unionByName(table))
    return got.select("month", *_r([c for c in got.columns if c != "month"], 4))


@query("factors_from_batch")
def factors_from_batch_q(spark, sf_dir):
    """Q8: the newest batch's sub-ledger file, a CSV of the joined ledger,
    found through its upload, its factors stored and reread."""
    path = _scratch(spark)
    _joined(spark, sf_dir).select(F.col("order_date").alias("Order Date"), "region", *[F.col(f).alias(f.upper()) for f in FACTORS]) \
        .write.option("header", True).csv(f"{path}/upload")
    batches = td.ingestion_batches(spark, sf_dir)
    newest = batches.agg(F.max_by(F.struct("id", "company_id"), "id").alias("b")).first().b
    uploads = batches.select((F.col("id") * 10).alias("id"), F.col("id").alias("batch_id"), F.lit("SUBLEDGER").alias("file_type"),
                             F.lit(f"{path}/upload").alias("file_path"))
    rows, _, found = pipelines.factors_from_batch(spark, batches, uploads, newest.company_id, newest.id, f"{path}/store")
    return rows.select("month", *_r(FACTORS, 4), F.lit(",".join(found)).alias("found"))


@query("year_month_dates")
def year_month_dates_q(spark, sf_dir):
    """P5: ledger rows by the first day of their year and month, given as text
    with bad parts."""
    led = td.ledger(spark, sf_dir)
    year = F.when(F.col("order_id") % 17 == 0, "x").otherwise(F.year("order_date").cast("string"))
    mo = F.when(F.col("order_id") % 11 == 0, "13").otherwise(F.month("order_date").cast("string"))
    return led.groupBy(date_from_year_mo(year, mo).alias("month")).agg(F.count(F.lit(1)).alias("row_count"))


@query("numeric_columns")
def numeric_columns_q(spark, sf_dir):
    """Text columns whose values are all numbers become numbers (missing
    ones NULL), others stay as they are."""
    led = td.ledger(spark, sf_dir)
    line = F.col("line_no").cast("string")
    text = led.select("order_id", "line_no", F.concat(F.lit(" $"), line).alias("units"),
                      F.when(F.col("order_id") % 7 == 0, "N/A").otherwise(F.format_number("order_id", 0)).alias("reference"),
                      F.when(F.col("order_id") % 32 == 0, F.concat(line, F.lit("b"))).otherwise(line).alias("code"))
    return numeric_or_keep(text, ["units", "reference", "code"])


def _positions(df, *keys):
    """``df`` with the place of each row in its order, within ``keys``."""
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).drop("_at")


@query("dataset_order")
def dataset_order_q(spark, sf_dir):
    """O1: the place of each dataset in its user's part of the listing."""
    listed = registry.list_datasets(td.datasets(spark, sf_dir), td.trained_models(spark, sf_dir))
    return _positions(listed.select("id", "user_id"), "user_id")


@query("region_order")
def region_order_q(spark, sf_dir):
    """O2: the place of each region in the summary, by revenue."""
    listed = summaries.region_summary(td.ledger(spark, sf_dir))
    return _positions(listed.select("region"), F.lit(1))


@query("factor_month_order")
def factor_month_order_q(spark, sf_dir):
    """O3: the place of each month in the combined factor files."""
    listed = factor_files.combine_factor_files(factor_text_files(spark, sf_dir))
    return _positions(listed.select("month"), F.lit(1))
