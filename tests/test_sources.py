"""Ingest: CSV ledger, factor files, JSON payload, registries."""

import datetime as dt
import hashlib
import os
import tempfile

import pytest

from ledgerlens.operators.model import load_model
from ledgerlens.plans import pipelines
from ledgerlens.sources import factor_files, factor_store, ledger_csv, registry


def _write(text):
    d = tempfile.mkdtemp(prefix="ledgerlens-test-")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_read_and_clean_ledger_csv(spark):
    p = _write(" Order Date ,Region,Total Revenue,COGS,SG&A,,Empty\n"
               "2021-01-09,  EMEA ,\"$1,234.50\",10,1,,\n"
               "13/02/2020,NA,7,abc,2,,\n"
               ",,,,,,\n"
               "garbage,X,1,1,1,,\n"
               "01/02/2020,Y,,1,1,,\n")
    raw = ledger_csv.read_ledger_csv(spark, p)
    assert "empty" not in raw.columns and "order_date" in raw.columns
    assert raw.count() == 4                            # the all-empty row is gone
    clean = {r.order_date: r for r in ledger_csv.clean_ledger(raw, for_training=True).collect()}
    assert set(clean) == {dt.date(2021, 1, 9)}         # rows missing a target are dropped
    r = clean[dt.date(2021, 1, 9)]
    assert (r.region, r.total_revenue, r.cogs) == ("EMEA", 1234.5, 10.0)
    scoring = {r.order_date: r for r in ledger_csv.clean_ledger(raw, for_training=False).collect()}
    assert len(scoring) == 3                           # only the bad date is dropped
    feb = scoring[dt.date(2020, 2, 13)]                # day-first fallback
    assert feb.region is None and feb.cogs is None and feb.total_revenue == 7.0
    assert scoring[dt.date(2020, 1, 2)].region == "Y"  # month-first


def test_factor_file_detection_and_parse(spark):
    df = spark.createDataFrame([("Jan-20", "4.1 %"), ("Jan-20", "9"), ("Feb-20", "$5"), ("x", "1")],
                               "observation_date string, `Consumer Confidence (%)` string")
    out = factor_files.read_factor_file(df, "cci.csv").collect()
    assert [(r.month, r.cci) for r in out] == [(dt.date(2020, 1, 1), 4.1), (dt.date(2020, 2, 1), 5.0)]
    assert factor_files.detect_factor(["date", "value"])[0] == "cci"
    assert factor_files.detect_factor(["Months", "All groups CPI"])[0] == "cpi"
    with pytest.raises(ValueError):
        factor_files.read_factor_file(spark.createDataFrame([("a", "b")], "p string, q string"))
    cpi = spark.createDataFrame([("2020-01-15", "1.5")], "Months string, CPI string")
    with pytest.raises(ValueError):
        factor_files.combine_factor_files({"a.csv": cpi, "b.csv": cpi})


def test_factors_from_json(spark):
    doc = '{"rows":[{"date":"2023-01-15","CCI":101.0,"Oil":78.3},{"date":"2023-01-20","CCI":5.0},{"date":"bad"}]}'
    out = factor_files.factors_from_json(spark.createDataFrame([(doc,)], "payload string")).collect()
    assert len(out) == 1 and out[0].month == dt.date(2023, 1, 1) and out[0].cci == 101.0 and out[0].oil == 78.3


def test_registry(spark):
    b = spark.createDataFrame([(1, 10, "ok"), (2, 20, "ok")], "id long, company_id long, status string")
    u = spark.createDataFrame([(5, 1, "SUBLEDGER", "p5"), (3, 1, "SUBLEDGER", None), (4, 1, "SUBLEDGER", "p4"),
                               (6, 2, "FACTORS", "p6")], "id long, batch_id long, file_type string, file_path string")
    got = registry.resolve_batch_files(b, u).collect()
    assert [(r.batch_id, r.upload_id, r.file_path) for r in got] == [(1, 4, "p4")]
    assert registry.resolve_batch_files(b, u, company_id=20).count() == 0     # tenant check
    ds = spark.createDataFrame([(1, 7, "h1", dt.date(2020, 1, 1)), (2, 7, "h2", dt.date(2020, 1, 1))],
                               "id long, user_id long, file_hash string, uploaded_at date")
    ms = spark.createDataFrame([(1, 1, "m1", dt.date(2020, 1, 2))], "id long, dataset_id long, model_name string, trained_at date")
    lst = registry.list_datasets(ds, ms, user_id=7).collect()
    assert [(r.id, r.model_count) for r in lst] == [(2, 0), (1, 1)]
    cand = spark.createDataFrame([(8, 7, "h1"), (9, 7, "h9"), (10, 7, "h9")], "id long, user_id long, file_hash string")
    assert {r.id: r.is_new_dataset for r in registry.register_datasets(ds, cand).collect()} == {8: False, 9: True, 10: False}
    assert sorted(r.id for r in registry.append_datasets(ds, cand).collect()) == [1, 2, 9]
    assert registry.get_model(ms, 1).first().model_name == "m1" and registry.get_dataset(ds, ms, 1).first().model_count == 1
    new = spark.createDataFrame([("m1", 5), ("m2", 7), ("m2", 6)], "model_name string, id long")
    assert [(r.model_name, r.id) for r in registry.register_models(ms, new).collect()] == [("m2", 6)]


def test_rows_keep_the_order_of_their_files(spark):
    d = tempfile.mkdtemp(prefix="ledgerlens-test-")
    with open(os.path.join(d, "a_first.csv"), "w") as f:
        f.write("date,value\n2020-01-05,1\n")
    with open(os.path.join(d, "b_second.csv"), "w") as f:
        f.write("date,value\n" + "2020-01-07,2\n" * 5000)
    df = spark.read.option("header", True).csv(d)
    assert [r.cci for r in factor_files.read_factor_file(df).collect()] == [1.0]
    raw = ledger_csv.read_ledger_csv(spark, d)
    assert raw.orderBy("row_no").first().value == "1" and raw.count() == 5001


def test_fingerprints_stream_the_file(spark):
    p = _write("x" * 3_000_000)
    r = registry.fingerprint_files(spark, [p]).first()
    assert (r.file_size_bytes, r.file_hash) == (3_000_000, hashlib.sha256(b"x" * 3_000_000).hexdigest())


def test_factor_maintenance_reaches_the_store(spark):
    store = tempfile.mkdtemp(prefix="ledgerlens-test-") + "/store"
    cpi = spark.createDataFrame([("2020-01-15", "1.5"), ("2020-02-15", "2.5")], "Months string, CPI string")
    bad = spark.createDataFrame([("a", "b")], "p string, q string")
    rows, span, failed = pipelines.factor_upload(spark, {"c.csv": cpi, "bad.csv": bad}, store, 1)
    assert [r.cpi for r in rows.collect()] == [1.5, 2.5] and set(failed) == {"bad.csv"} and span.first().row_count == 2
    p = _write("Order Date,CPI,Oil\n2020-02-03,9,50\n2020-03-03,,60\n")
    b = spark.createDataFrame([(1, 1, "ok")], "id long, company_id long, status string")
    u = spark.createDataFrame([(5, 1, "SUBLEDGER", p)], "id long, batch_id long, file_type string, file_path string")
    rows, _, found = pipelines.factors_from_batch(spark, b, u, 1, 1, store)
    assert {r.month.month: (r.cpi, r.oil) for r in rows.collect()} == {1: (1.5, None), 2: (9.0, 50.0), 3: (None, 60.0)} and set(found) == {"cpi", "oil"}
    with pytest.raises(ValueError):
        pipelines.factors_from_batch(spark, b, u, 2, 1, store)
    rows, _ = pipelines.factor_refresh(spark, store, 1, "2020-02-01", {"cci": 7.0})
    assert {r.month.month: (r.cci, r.cpi) for r in rows.collect()}[2] == (7.0, None)
    with pytest.raises(ValueError):
        pipelines.factor_refresh(spark, store, 1, "1/2/2020", {})
    assert factor_store.load_company_factors(spark, store, 99) is None and factor_store.company_factor_rows(spark, store + "x", 1) is None


def test_training_from_file_to_registries(spark):
    rows = "".join(f"2021-{1 + i % 12:02d}-{1 + i % 28:02d},{'EMEA' if i % 2 else 'APAC'},{100 + 3 * i},{50 + i},{10 + i % 7},{20 + i}\n" for i in range(80))
    p = _write("Order Date,Region,Total Revenue,COGS,SG&A,Freight\n" + rows + "bad,EMEA,1,1,1,1\n")
    root = tempfile.mkdtemp(prefix="ledgerlens-test-")
    out = pipelines.train_upload(spark, p, root, 3, "m1")
    assert out["is_new_dataset"] and out["rows_dropped"] == 1 and out["metrics"].count() == 6 and not any(out["external_factors_used"].values())
    again = pipelines.train_upload(spark, p, root, 3, "m2", grain="day_segment")
    assert not again["is_new_dataset"] and again["dataset_id"] == out["dataset_id"]
    with pytest.raises(ValueError):
        pipelines.train_upload(spark, p, root, 3, "m1")
    assert load_model(spark, f"{root}/coefs", "m1").targets == ["total_revenue", "cogs", "sga"]
    pipelines.remove_model(spark, root, out["model_id"])
    assert [r.model_name for r in spark.read.parquet(f"{root}/models").collect()] == ["m2"]
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{root}/coefs", "m1")
