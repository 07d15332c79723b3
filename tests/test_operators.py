"""Operators against pandas / numpy brute force on small frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import correlate, forecast, joins, medians, rollup, whatif
from ledgerlens.operators.medians import exact_medians
from ledgerlens.plans import pipelines


def test_exact_medians_match_pandas(spark):
    rng = np.random.default_rng(0)
    n = 5000
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]),
                        "x": rng.integers(0, 50, n).astype(float), "y": rng.normal(size=n)})
    pdf.loc[::9, "y"] = np.nan
    pdf.loc[pdf.k == "b", "x"] = np.nan            # a group with no value
    got = exact_medians(spark.createDataFrame(pdf), ["k"], ["x", "y"]).toPandas()
    exp = pdf.groupby("k", dropna=False)[["x", "y"]].median().reset_index()
    got = got.sort_values("k", na_position="last").reset_index(drop=True)
    exp = exp.sort_values("k", na_position="last").reset_index(drop=True)
    assert np.allclose(got[["x", "y"]].to_numpy(dtype=float), exp[["x", "y"]].to_numpy(dtype=float),
                       equal_nan=True)
    g = exact_medians(spark.createDataFrame(pdf), [], ["y"]).first()[0]
    assert np.isclose(g, pdf.y.median())


def test_correlation_pairwise_and_constant(spark):
    rng = np.random.default_rng(1)
    n = 2000
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(size=n), "c": 5.0})
    pdf.loc[::4, "b"] = np.nan
    got = correlate.correlation_long(spark.createDataFrame(pdf).repartition(3), ["a", "b", "c"]).toPandas()
    m = got.pivot(index="row_col", columns="col_col", values="corr")
    exp = pdf.corr().round(4).fillna(0.0)
    assert np.allclose(m.loc[exp.index, exp.columns].to_numpy(), exp.to_numpy())
    assert m.loc["c", "c"] == 0.0                   # constant -> 0, diagonal included
    assert (m.to_numpy() == m.to_numpy().T).all()   # symmetric


def test_daily_rollup_mode_fill(spark):
    d = dt.date
    led = spark.createDataFrame([
        (d(2021, 1, 5), "X", 1.0, None), (d(2021, 1, 5), "Y", 2.0, None),
        (d(2021, 1, 5), "Y", None, None), (d(2021, 2, 7), None, 4.0, None),
        (d(2021, 3, 1), "Z", 1.0, 10.0)], "order_date date, region string, raw_material double, cogs double")
    fac = spark.createDataFrame([(d(2021, 2, 1), 1.5), (d(2021, 4, 1), 9.0)], "month date, cci double")
    out = {r.order_date: r for r in rollup.daily_rollup(led, fac).collect()}
    assert out[d(2021, 1, 5)].region == "Y" and out[d(2021, 1, 5)].raw_material == 3.0
    assert out[d(2021, 1, 5)].cogs == 0.0           # all-NULL sum is 0
    assert out[d(2021, 2, 7)].region is None
    assert out[d(2021, 1, 5)].cci == 1.5            # leading gap back-filled
    assert out[d(2021, 3, 1)].cci == 1.5            # gap month forward-filled


def test_attach_factors_keeps_rows_and_ledger_values(spark):
    d = dt.date
    led = spark.createDataFrame([(d(2021, 1, 5), 7.0), (d(2021, 1, 9), None), (d(2021, 5, 1), None)],
                                "order_date date, cci double")
    fac = spark.createDataFrame([(d(2021, 1, 1), 1.0, 2.0)], "month date, cci double, oil double")
    got = sorted(joins.attach_factors(led, fac).collect())
    assert [(r.cci, r.oil) for r in got] == [(7.0, 2.0), (1.0, 2.0), (None, None)]


def test_upsert_and_replace(spark):
    d = dt.date
    old = spark.createDataFrame([(d(2021, 1, 1), 1.0, 5.0), (d(2021, 2, 1), 2.0, 6.0)], "month date, cci double, oil double")
    new = spark.createDataFrame([(d(2021, 2, 1), None, 60.0), (d(2021, 3, 1), 3.0, None)], "month date, cci double, oil double")
    up = {r.month: (r.cci, r.oil) for r in joins.upsert_factors(old, new).collect()}
    assert up == {d(2021, 1, 1): (1.0, 5.0), d(2021, 2, 1): (2.0, 60.0), d(2021, 3, 1): (3.0, None)}
    again = {r.month: (r.cci, r.oil) for r in joins.upsert_factors(joins.upsert_factors(old, new), new).collect()}
    assert again == up                               # idempotent
    rep = {r.month: (r.cci, r.oil) for r in joins.replace_month(old, "2021-02-01", {"cci": 9.0}).collect()}
    assert rep[d(2021, 2, 1)] == (9.0, None)


def test_whatif_append_and_replace_latest(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, 30.0), (3, 2.0, 20.0)], "row_no int, cci double, oil double")
    app = whatif.append_row(df, ["cci", "oil"], {"cci": 9.0})
    assert app.count() == 4
    added = [r for r in app.collect() if r.cci == 9.0]
    assert len(added) == 1 and added[0].oil == 20.0   # median fills the unspecified value
    rep = {r.row_no: r.cci for r in whatif.replace_latest(df, ["row_no"], {"cci": 7.0}).collect()}
    assert rep == {1: 1.0, 2: 3.0, 3: 7.0}


def test_future_rows_counts_and_fallback(spark):
    d = dt.date
    hist = spark.createDataFrame([
        ("R", "G", "C", "cu", "t", 1.0), ("R", "G", "C", "cu", "t", 3.0), ("R", None, "C", "cu", "t", 5.0)],
        "region string, geo string, country string, customer string, item_type string, raw_material double")
    fac = spark.createDataFrame([(d(2022, 1, 1), 1.0), (d(2022, 3, 1), 3.0)], "month date, cci double")
    rows = forecast.future_rows(hist, fac, d(2022, 1, 1), d(2022, 4, 1)).collect()
    assert len(rows) == 2 * 4                        # segments x months
    by = {(r.geo, r.order_date): r for r in rows}
    assert by[("G", d(2022, 1, 1))].raw_material == 2.0
    assert by[(None, d(2022, 1, 1))].raw_material == 5.0   # NULL is a segment value
    assert by[("G", d(2022, 2, 1))].cci == 3.0        # absent month -> latest row
    assert forecast.future_start(d(2021, 12, 15)) == d(2022, 1, 1)
    assert forecast.future_start(d(2021, 12, 15), "2022-05-20") == d(2022, 5, 1)


def test_first_row_per_month(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2021, 1, 1), 2, 5.0), (d(2021, 1, 1), 1, 4.0), (d(2021, 2, 1), 3, None)],
                               "month date, _src_row int, cci double")
    got = {r.month: r.cci for r in rollup.first_row_per_month(df, ["_src_row"], "month", ["cci"]).collect()}
    assert got == {d(2021, 1, 1): 4.0, d(2021, 2, 1): None}


def test_medians_narrow_large_groups(spark, monkeypatch):
    monkeypatch.setattr(medians, "SMALL", 100)
    monkeypatch.setattr(medians, "BUCKETS", 16)
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None, "d"], n, p=[.7, .2, .09, .01]), "x": rng.integers(0, 4, n).astype(float),
                        "y": rng.normal(size=n) * 10.0 ** rng.integers(-3, 6, n), "z": np.where(np.arange(n) % 2 == 0, 1.0, 2.0), "w": np.nan})
    cols = ["x", "y", "z", "w"]
    got = exact_medians(spark.createDataFrame(pdf), ["k"], cols).toPandas().sort_values("k", na_position="last")
    exp = pdf.groupby("k", dropna=False)[cols].median().reset_index().sort_values("k", na_position="last")
    assert np.allclose(got[cols].to_numpy(float), exp[cols].to_numpy(float), equal_nan=True)
    assert np.allclose(np.array(list(exact_medians(spark.createDataFrame(pdf), [], cols[:3]).first())), pdf[cols[:3]].median())


def test_many_large_groups_share_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(medians, "SMALL", 20)
    monkeypatch.setattr(medians, "CELLS", 64)
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"k": rng.integers(0, 5, n), "x": rng.normal(size=n), "y": np.where(rng.random(n) < 0.2, np.inf, rng.normal(size=n) * 1e6)})
    pdf.loc[::9, "y"] = -np.inf
    seen = []
    real = medians._open

    def opened(*args, **kw):
        out = real(*args, **kw)
        seen.append(out.groupBy("_g", "_c", "_b").count().groupBy("_g", "_c").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(medians, "_open", opened)
    got = exact_medians(spark.createDataFrame(pdf), ["k"], ["x", "y"]).toPandas().sort_values("k")
    assert np.array_equal(got[["x", "y"]].to_numpy(), pdf.groupby("k")[["x", "y"]].median().to_numpy())
    assert 3 < len(seen) < 10 and max(seen[:-1]) <= 18  # 16 buckets and the two ends, not BUCKETS


def test_one_latest_row_is_replaced(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0), (2, 6.0), (2, 5.5)], "row_no int, cci double")
    got = sorted(tuple(r) for r in whatif.replace_latest(df, ["row_no"], {"cci": 9.0}).collect())
    assert got == [(1, 5.0), (2, 5.5), (2, 6.0), (2, 9.0)]


def test_empty_columns_are_left_out_of_matrices(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, 1.0)], "a double, b double, c double")
    got = {(r.row_col, r.col_col): r["corr"] for r in correlate.correlation_long(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "a"): 1.0, ("a", "c"): -1.0, ("c", "a"): -1.0, ("c", "c"): 1.0}


def test_grains(spark):
    with pytest.raises(ValueError):
        pipelines.train(spark.createDataFrame([], "order_date date, cogs double"), grain="no_such_grain")
    d = dt.date
    led = spark.createDataFrame([(d(2021, 1, 5), "X", 1.0), (d(2021, 1, 5), "X", 2.0), (d(2021, 1, 5), None, 4.0)], "order_date date, region string, cogs double")
    assert sorted((r.region or "", r.cogs) for r in rollup.segment_rollup(led).collect()) == [("", 4.0), ("X", 3.0)]
    assert [r.region for r in rollup.segment_rollup(led.drop("cogs")).orderBy("region").collect()] == [None, "X"]  # no totals to make
    with pytest.raises(ValueError):
        pipelines.request_date("2021-1-5")


def test_global_medians_by_sketch_and_counts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 20_000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float), "c": np.nan, "d": np.inf,
                        "e": rng.normal(size=n) * 10.0 ** rng.integers(-8, 8, n)})
    pdf.loc[::3, "a"] = np.nan
    pdf.loc[1:, "d"] = 1.0
    df, cols = spark.createDataFrame(pdf).repartition(5), list("abcde")

    def same():
        got = np.array(exact_medians(df, [], cols).first(), dtype=float)
        assert np.array_equal(got, pdf[cols].median().to_numpy(), equal_nan=True)

    same()
    monkeypatch.setattr(medians, "ACCURACY", 20)    # wide brackets: their values are narrowed by buckets
    monkeypatch.setattr(medians, "SMALL", 50)
    monkeypatch.setattr(medians, "BUCKETS", 8)
    same()
    aside = lambda brackets: real([(lo + 1e9, hi + 1e9) for lo, hi in brackets])
    real = medians._inside
    monkeypatch.setattr(medians, "_inside", aside)  # brackets that miss are seen
    same()
    empty = df.where("a > 1e9")
    assert exact_medians(empty, [], cols).first() == (None,) * 5


def _matrix(df):
    return {(r.row_col, r.col_col): r["corr"] for r in df.collect()}


@pytest.mark.parametrize("rows", [60, 2, 1, 0])
def test_whatif_state_equals_whole_tables(spark, tmp_path, rows):
    rng = np.random.default_rng(rows)
    pdf = pd.DataFrame({"row_no": np.arange(60), "a": rng.normal(size=60), "b": rng.normal(size=60), "c": 3.0, "e": np.nan})
    pdf.loc[::4, "b"] = np.nan
    pdf.loc[58:, :] = [99, 1e9, 2.0, 3.0, np.nan]   # the latest row twice, an outlier
    cols = ["a", "b", "c", "e"]
    df = spark.createDataFrame(pdf, "row_no double, a double, b double, c double, e double").where(F.col("row_no") >= 0)
    df = df.replace(float("nan"), None).where(F.lit(rows > 0)).orderBy(F.desc("row_no")).limit(max(rows, 1))
    whatif.WhatIfState.build(df, cols, ["row_no"]).save(f"{tmp_path}/s")
    state = whatif.WhatIfState.load(spark, f"{tmp_path}/s")
    given = {"a": 5.0, "c": 4.0}
    assert _matrix(state.matrix()) == _matrix(correlate.correlation_long(df, cols))
    assert _matrix(state.matrix(append=given)) == _matrix(correlate.correlation_long(whatif.append_row(df, cols, given), cols))
    replaced = whatif.replace_latest(df, ["row_no"], given)
    assert _matrix(state.matrix(replace_latest=given)) == _matrix(correlate.correlation_long(replaced, cols))
    cross = state.matrix(append=given, rows=["a"], columns=["b", "c"])
    assert _matrix(cross) == _matrix(correlate.correlation_long(whatif.append_row(df, cols, given), cols, ["a"], ["b", "c"]))
    assert all("/s/moments/" in f for f in cross.inputFiles())  # no row of the table is read again
