"""The user-visible pipelines (Q1-Q18) composed from the operators.

Each returns DataFrames (and, for training, the fitted model); the only
driver reads are bounded scalars (last ledger date, a model's coefficient
table, the latest factor row).
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import re
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import correlate, forecast, joins, rollup, score, summaries, whatif
from ledgerlens.operators.model import LinearModel, drop_model, save_model, train_model
from ledgerlens.schema import ACTUAL_COL, DIMS, FACTORS, LEDGER_MEASURES, MODEL_USED_COL, PRED_COL
from ledgerlens.shared import materialise
from ledgerlens.sources import factor_files, factor_store, ledger_csv, manifest, registry


# ---- Q1 ------------------------------------------------------------------
def train(ledger: DataFrame, factors: DataFrame | None = None, name: str = "model",
          test_size: float = 0.25, seed: int = 42, grain: str = "day"):
    """Q1: clean ledger -> daily roll-up with filled month factors -> model
    matrix -> baseline + ridge per target -> metrics.

    ``grain='day'`` (default) fits on daily totals; ``'day_segment'`` on
    totals of a day and segment, ``'row'`` on ledger rows (D19).  The test side
    has ``ceil(n * test_size)`` rows at every grain.  Another grain is an error."""
    if grain not in ("day", "day_segment", "row"):
        raise ValueError(f"unknown grain {grain!r}")
    if grain == "day":
        data = rollup.daily_rollup(ledger, factors)
        return train_model(data, name=name, test_size=test_size, seed=seed,
                           split_keys=["order_date"])
    if grain == "day_segment":
        data = rollup.segment_rollup(ledger, factors)
        keys = ["order_date", *[c for c in DIMS if c in data.columns]]
        return train_model(data, name=name, test_size=test_size, seed=seed, split_keys=keys)
    data = score.with_date_features(ledger.where(F.col("order_date").isNotNull()))
    if factors is not None:
        data = joins.attach_factors(data, factors)
    keys = [c for c in ("order_date", "order_id", "line_no", "row_no") if c in data.columns]
    return train_model(data, name=name, test_size=test_size, seed=seed,
                       split_keys=keys)


def request_date(value) -> _dt.date:
    """A date, or text in the form ``YYYY-MM-DD`` and no other."""
    if isinstance(value, _dt.date):
        return value
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(value)):
        raise ValueError(f"date {value!r} is not YYYY-MM-DD")
    return _dt.date.fromisoformat(str(value))


# ---- Q2 ------------------------------------------------------------------
def forecast_range(model: LinearModel, start, end, snapshots: DataFrame,
                   scenario_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q2: every snapshot row (constant dims / costs / factors, P18) is
    repeated on each month of [start, end] (G1) and scored as the 1st of the
    month.  Returns (monthly rows, totals per scenario: A6)."""
    s, e = request_date(start), request_date(end)
    if e < s:
        raise ValueError("end_date must be >= start_date")
    scen = scenario_cols or []
    rows = snapshots.withColumn("order_date", F.explode(forecast.month_calendar(s, e)))
    scored = score.score(model, rows)
    monthly = scored.select(*scen, F.date_format("order_date", "yyyy-MM").alias("month"),
                            F.col("order_date").alias("date"), *PRED_COL.values(),
                            *MODEL_USED_COL.values())
    totals = (monthly.groupBy(*scen)
              .agg(F.round(F.sum(F.coalesce(PRED_COL["total_revenue"], F.lit(0.0))), 4).alias("total_revenue"),
                   F.round(F.sum(F.coalesce(PRED_COL["cogs"], F.lit(0.0))), 4).alias("total_cogs"),
                   F.round(F.sum(F.coalesce(PRED_COL["sga"], F.lit(0.0))), 4).alias("total_sga"),
                   F.count(F.lit(1)).alias("months_count")))
    return monthly, totals


# ---- Q3 ------------------------------------------------------------------
def _ci_eq(c: str, v: str):
    return F.lower(F.trim(F.col(c).cast("string"))) == v.strip().lower()


def filter_history(ledger: DataFrame, region=None, geo=None, country=None,
                   history_start=None, history_end=None) -> DataFrame:
    """P11 + P12: case-insensitive trimmed equality on region / geo /
    country, inclusive date window (D3: the history window)."""
    df = ledger
    for c, v in (("region", region), ("geo", geo), ("country", country)):
        if v:
            df = df.where(_ci_eq(c, v))
    if history_start:
        df = df.where(F.col("order_date") >= F.lit(request_date(history_start)))
    if history_end:
        df = df.where(F.col("order_date") <= F.lit(request_date(history_end)))
    return df


OUT_DIMS = ["region", "geo", "country", "item_type", "customer"]


def forecast_batch(model: LinearModel, ledger: DataFrame, factors: DataFrame | None,
                   region=None, geo=None, country=None, history_start=None, history_end=None,
                   forecast_start=None, forecast_end=None, overrides: dict | None = None,
                   totals_digits: int = 4, digits: int | None = 4, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Q3: score the filtered history (with actuals) and, when
    ``forecast_end`` lies past the ledger, every segment x future month;
    union with ``row_type``; totals (A7).  Returns (rows, summary).  The ledger
    is read for its last date, its filters, the medians and the scores, so it
    is written once, unless it is read from files already (``written``)."""
    if not written:
        ledger = materialise(ledger, "batch-ledger")
    last = ledger.agg(F.max("order_date")).first()[0]          # A16, unfiltered
    if last is None:
        raise ValueError("the ledger has no dated row")
    base = filter_history(ledger, region, geo, country, history_start, history_end)
    if base.isEmpty():
        raise ValueError("no ledger row matches the filters")
    hist = score.actuals(base)
    if factors is not None:
        hist = joins.attach_factors(hist, factors)
    hist, _ = correlate.apply_overrides(hist, overrides)       # D12
    keep = ["order_date", *OUT_DIMS, *ACTUAL_COL.values()]
    h = score.score(model, hist, digits=digits).select(
        *[F.col(c) if c in hist.columns else F.lit(None).cast("string").alias(c) for c in keep],
        *PRED_COL.values(), "predicted_gross_profit", *MODEL_USED_COL.values()
    ).withColumn("row_type", F.lit("historical"))
    parts = [h]
    if forecast_end is not None and last is not None:
        start = forecast.future_start(last, forecast_start)
        if forecast.month_start(forecast_end) >= start:
            fut = forecast.future_rows(base, factors, start, forecast_end)
            fut, _ = correlate.apply_overrides(fut, overrides)
            f = score.score(model, fut, digits=digits).select(
                "order_date", *[F.col(c) if c in fut.columns else F.lit(None).cast("string").alias(c)
                                for c in OUT_DIMS],
                *PRED_COL.values(), "predicted_gross_profit", *MODEL_USED_COL.values()
            ).withColumn("row_type", F.lit("future"))
            parts.append(f)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)      # U1
    return rows, batch_totals(rows, totals_digits)


def batch_totals(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Historical / future / total counts, actual revenue and gross
    profit over history, predicted revenue and gross profit over all rows
    (rounded to ``digits``, 4 as the reference)."""
    hist = F.col("row_type") == "historical"
    return rows.agg(
        F.count_if(hist).alias("historical_row_count"),
        F.count_if(F.col("row_type") == "future").alias("future_row_count"),
        F.count(F.lit(1)).alias("total_row_count"),
        F.round(F.sum(F.when(hist, F.coalesce(ACTUAL_COL["total_revenue"], F.lit(0.0)))), digits)
        .alias("gross_actual_revenue"),
        F.round(F.sum(F.when(hist, F.coalesce(ACTUAL_COL["gross_profit"], F.lit(0.0)))), digits)
        .alias("total_actual_gross_profit"),
        F.round(F.sum(F.coalesce(PRED_COL["total_revenue"], F.lit(0.0))), digits)
        .alias("gross_predicted_revenue"),
        F.round(F.sum("predicted_gross_profit"), digits).alias("total_predicted_gross_profit"))


# ---- Q4 / Q5 -------------------------------------------------------------
def forecast_map(model: LinearModel, rows: DataFrame) -> DataFrame:
    """Q4: score posted rows, then predicted revenue / COGS / SG&A by region."""
    s = score.score(model, rows)
    return summaries.region_summary(s, PRED_COL["total_revenue"], PRED_COL["cogs"], PRED_COL["sga"])


def forecast_map_batch(model: LinearModel, ledger: DataFrame, factors: DataFrame | None, digits: int | None = 4
                       ) -> tuple[DataFrame, DataFrame]:
    """Q5: ledger -> factors (J1) -> scores; returns (a row for every ledger
    row: date, dimensions, predictions, models used; region summary).  Rows
    with an unparseable date are dropped (D17)."""
    j = joins.attach_factors(ledger, factors) if factors is not None else ledger
    dims = [c for c in DIMS if c in j.columns]
    detail = score.score(model, j, keep=["order_date", *dims], digits=digits)
    summary = summaries.region_summary(detail, PRED_COL["total_revenue"], PRED_COL["cogs"], PRED_COL["sga"])
    return detail, summary


# ---- Q6-Q9 (factor maintenance) --------------------------------------------
def _stored(spark, store: str, company_id, change) -> tuple[DataFrame, DataFrame]:
    """Commits ``change(stored factors or None)`` as the company's factors
    (S9); returns (stored rows, A15 date range)."""
    factor_store.update_company_factors(spark, store, company_id, change)
    factors = factor_store.company_factor_rows(spark, store, company_id)
    return factors, summaries.date_range(factors, "month")


def factor_upload(spark, files: dict[str, DataFrame], store: str, company_id) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Q6: parse up to six factor files, merge them and replace the company's
    stored factors.  Files that can't be read are passed over and reported.
    Returns (stored rows, date range, reason by failed file)."""
    failed: dict[str, str] = {}
    merged = factor_files.combine_factor_files(files, failed)
    return *_stored(spark, store, company_id, lambda old: merged), failed


def factors_from_csv(spark, wide: DataFrame, store: str, company_id) -> tuple[DataFrame, DataFrame, list[str]]:
    """Q7: factors found in a wide ledger are upserted into the company's
    stored ones (J4).  Returns (stored rows, date range, factors found)."""
    new, found = factor_files.extract_factors_from_ledger(wide)
    return *_stored(spark, store, company_id, lambda old: new if old is None else joins.upsert_factors(old, new)), found


def factors_from_batch(spark, batches: DataFrame, uploads: DataFrame, company_id, batch_id, store: str
                       ) -> tuple[DataFrame, DataFrame, list[str]]:
    """Q8: Q7 over the sub-ledger file of a company's batch (S4); an error when
    the batch isn't the company's or has no such file."""
    hit = registry.resolve_batch_files(batches, uploads, company_id=company_id, batch_id=batch_id).select("file_path").first()
    if hit is None:
        raise ValueError(f"batch {batch_id} of company {company_id} has no sub-ledger file")
    wide = ledger_csv.read_csv_text(spark, hit.file_path)
    return factors_from_csv(spark, wide, store, company_id)


def factor_refresh(spark, store: str, company_id, month, values: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Q9: replace one month's whole row of the stored factors."""
    at = request_date(month)

    def change(old: DataFrame | None) -> DataFrame:
        if old is None or old.isEmpty():
            raise ValueError(f"company {company_id} has no stored factors")
        return joins.replace_month(old, at, values)

    return _stored(spark, store, company_id, change)


# ---- Q1 end to end ----------------------------------------------------------
def train_upload(spark, path: str, root: str, user_id: int, name: str, payload: DataFrame | None = None,
                 test_size: float = 0.25, seed: int = 42, grain: str = "day") -> dict:
    """Q1 from file to registries under ``root`` (datasets, models, metrics,
    coefs as parquet): read (S1), clean (S2), factors from JSON (S11),
    fingerprint (S12), train, save the coefficients (S21), register dataset
    (S13) and model (S19).  A model name already taken is an error.

    Names, ids and (user, hash) pairs are claimed by files that one writer
    alone can create, so they stay unique with any number of writers; a
    failed training gives its claims back (a lost driver's stay until
    ``remove_model`` or ``manifest.release``).

    Returns dataset_id, is_new_dataset, metrics, external_factors_used,
    rows_dropped and training_duration_seconds."""
    models = _registry(spark, f"{root}/models", MODEL_ROW)
    held = [_name_claim(root, name)]
    if not models.where(F.col("model_name") == name).isEmpty() or not manifest.claim(spark, held[0]):
        raise ValueError(f"model name {name!r} is taken")
    try:
        return _train_claimed(spark, path, root, user_id, name, payload, test_size, seed, grain, held)
    except BaseException:
        for c in held:
            manifest.release(spark, c)
        raise


def _name_claim(root: str, name: str) -> str:
    return f"{root}/claims/model-name-{hashlib.sha256(name.encode('utf-8')).hexdigest()}"


def _claim_id(spark, root: str, kind: str, table: DataFrame, held: list[str]) -> int:
    """The next id of a registry that no other writer has claimed."""
    n = (table.agg(F.max("id")).first()[0] or 0) + 1
    while not manifest.claim(spark, f"{root}/claims/{kind}-id-{n}"):
        n += 1
    held.append(f"{root}/claims/{kind}-id-{n}")
    return n


def _train_claimed(spark, path, root, user_id, name, payload, test_size, seed, grain, held: list[str]) -> dict:
    """``train_upload`` once the name is claimed; ``held``: claims to give
    back on failure."""
    began = time.time()
    raw = ledger_csv.read_ledger_csv(spark, path)
    clean = ledger_csv.clean_ledger(raw, for_training=True)
    if clean.isEmpty():
        raise ValueError("no row has a date and all targets")
    factors = factor_files.factors_from_json(payload) if payload is not None else None
    used = {f: factors is not None and f in factors.columns and not factors.where(F.col(f).isNotNull()).isEmpty() for f in FACTORS}
    used = {f: used[f] or f in clean.columns for f in FACTORS}
    file = registry.fingerprint_files(spark, [path]).first()
    datasets = _registry(spark, f"{root}/datasets", DATASET_ROW)
    known = datasets.where((F.col("user_id") == user_id) & (F.col("file_hash") == file.file_hash)).select("id").first()
    dataset_id, is_new = (known.id, False) if known is not None else _claim_dataset(spark, root, datasets, user_id, file.file_hash, held)
    profile = registry.profile_dataset(clean).select(
        F.lit(dataset_id).cast("long").alias("id"), F.lit(user_id).cast("long").alias("user_id"), F.lit(file.file_name).alias("original_filename"),
        F.lit(file.file_hash).alias("file_hash"), F.lit(file.file_size_bytes).cast("long").alias("file_size_bytes"), "row_count", "column_names",
        "date_range_start", "date_range_end", "target_columns", F.current_timestamp().alias("uploaded_at"))
    model, metrics = train(clean, factors, name=name, test_size=test_size, seed=seed, grain=grain)
    save_model(model, f"{root}/coefs", spark)
    if is_new:
        profile.select(*[c.split()[0] for c in DATASET_ROW.split(", ")]).write.mode("append").parquet(f"{root}/datasets")
    took = time.time() - began
    model_id = _claim_id(spark, root, "model", _registry(spark, f"{root}/models", MODEL_ROW), held)
    spark.createDataFrame([(model_id, dataset_id, user_id, name, model.targets, model.features, used, test_size, seed,
                            _dt.datetime.now(), took)], MODEL_ROW).write.mode("append").parquet(f"{root}/models")
    if metrics is not None:
        metrics.withColumn("model_id", F.lit(model_id).cast("long")).write.mode("append").parquet(f"{root}/metrics")
    return {"dataset_id": dataset_id, "is_new_dataset": is_new, "model_id": model_id, "model": model, "metrics": metrics,
            "external_factors_used": used, "rows_dropped": ledger_csv.dropped_rows(raw.count(), clean),
            "training_duration_seconds": took}


def _claim_dataset(spark, root: str, datasets: DataFrame, user_id: int, file_hash: str, held: list[str]) -> tuple[int, bool]:
    """(id, True) for the one writer that registers the user's file, (its id,
    False) for all others."""
    path = f"{root}/claims/dataset-{user_id}-{file_hash}"
    n = _claim_id(spark, root, "dataset", datasets, held)
    if manifest.claim(spark, path, str(n)):
        held.append(path)
        return n, True
    manifest.release(spark, held.pop())  # the id isn't needed
    return int(manifest.read_text(spark, path)), False


DATASET_ROW = ("id long, user_id long, original_filename string, file_hash string, file_size_bytes long, row_count long, "
               "column_names string, date_range_start date, date_range_end date, target_columns string, uploaded_at timestamp")
MODEL_ROW = ("id long, dataset_id long, user_id long, model_name string, targets array<string>, feature_columns array<string>, "
             "external_factors_used map<string,boolean>, test_size double, random_state long, trained_at timestamp, "
             "training_duration_seconds double")


def _registry(spark, path: str, schema: str) -> DataFrame:
    """A registry table; empty where none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)  # a first writer's folder may hold no file yet
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def remove_model(spark, root: str, model_id: int) -> None:
    """A model's registry row and its coefficients go."""
    models = spark.read.parquet(f"{root}/models")
    name = registry.get_model(models, model_id).select("model_name").first()
    if name is None:
        raise ValueError(f"no model {model_id}")
    left = materialise(registry.remove_models(models, registry.get_model(models, model_id)), "models")
    left.write.mode("overwrite").parquet(f"{root}/models")
    drop_model(spark, f"{root}/coefs", name.model_name)
    manifest.release(spark, _name_claim(root, name.model_name))


# ---- Q10-Q18 (correlation family) -----------------------------------------
def factor_correlation(stored: DataFrame, append: dict | None = None, append_month=None,
                       replace_latest: dict | None = None) -> DataFrame:
    """Q10 / Q13 / Q14 on a monthly factor table."""
    facs = [f for f in FACTORS if f in stored.columns]
    df = stored
    if append:
        df = whatif.append_row(stored, facs, append,
                               extra={"month": request_date(append_month)} if append_month else None)
    elif replace_latest:
        df = whatif.replace_latest(stored, ["month"], replace_latest)
    return correlate.correlation_long(df, facs)


def ledger_correlation(ledger: DataFrame, factors: DataFrame | None, kind: str = "full",
                       overrides: dict | None = None, append: dict | None = None,
                       replace_latest: dict | None = None, order_cols: list[str] | None = None
                       ) -> DataFrame:
    """Q11 / Q12 / Q15-Q18: ledger (+ factors) -> optional overrides (P17),
    appended row (U2) or latest-row update (U4) -> full (A10) or cross (A9).
    Columns without values are left out (P20), seen in the same pass."""
    j, sl, ext = _correlated(ledger, factors, overrides)
    cols = sl + ext
    if len(cols) < 2:
        raise ValueError(f"need at least two numeric columns, found {cols}")
    if append:
        # the numbers are read three times (sketch, counts, moments): the join is written once
        j = materialise(j.select(*[F.col(c).cast("double").alias(c) for c in cols]), "whatif-rows")
        j = whatif.append_row(j, cols, {f: append.get(f) for f in ext}, written=True)
    elif replace_latest:
        order = order_cols or [c for c in ("order_date", "row_no") if c in j.columns]
        j = whatif.replace_latest(j, order, replace_latest)
    if kind == "cross":
        return correlate.correlation_long(j, cols, rows=sl, columns=ext)
    return correlate.correlation_long(j, cols)


def whatif_state(ledger: DataFrame, factors: DataFrame | None, overrides: dict | None = None,
                 order_cols: list[str] | None = None) -> whatif.WhatIfState:
    """The state from which every Q15-Q18 variant of one ledger is answered
    without reading the ledger again (``WhatIfState.matrix``)."""
    j, sl, ext = _correlated(ledger, factors, overrides)
    order = order_cols or [c for c in ("order_date", "row_no") if c in j.columns]
    return whatif.WhatIfState.build(j, sl + ext, order)


def _correlated(ledger, factors, overrides):
    j = joins.attach_factors(ledger, factors) if factors is not None else ledger
    j, _ = correlate.apply_overrides(j, overrides)
    return j, [c for c in LEDGER_MEASURES if c in j.columns], [c for c in FACTORS if c in j.columns]


def correlated_rows(ledger: DataFrame, factors: DataFrame | None, overrides: dict | None = None) -> DataFrame:
    """A10: ``row_count`` of the full matrix: rows with any value."""
    j, sl, ext = _correlated(ledger, factors, overrides)
    return j.agg(F.count(F.coalesce(*[F.col(c).cast("double") for c in sl + ext])).alias("row_count"))


__all__ = ["train", "forecast_range", "forecast_batch", "batch_totals", "forecast_map",
           "forecast_map_batch", "filter_history", "factor_upload",
           "factors_from_csv", "factors_from_batch", "factor_refresh", "train_upload", "remove_model", "correlated_rows", "whatif_state", "factor_correlation", "ledger_correlation", "DIMS"]
