"""Training and scoring with a categorical kept as a table, against the dense trainer's formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import score
from ledgerlens.operators.model import load_model, save_model, train_model

ALPHAS = [0.1, 1.0, 10.0, 100.0]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    n = 400
    level = np.where(r.random(n) < 0.33, 0, r.integers(0, 60, n))  # a hot level, some of one row
    pdf = pd.DataFrame({"order_date": pd.date_range("2020-01-01", periods=n).date, "customer": [f"c{k:02d}" for k in level],
                        "region": [["N", "S", "W"][k % 3] for k in level],  # nested in customer: the design is rank-deficient
                        "raw_material": r.normal(10, 2, n), "freight": r.normal(5, 1, n)})
    pdf.loc[::17, "freight"] = np.nan
    pdf["total_revenue"] = 3 * pdf.raw_material + level / 7 + r.normal(0, 1, n)
    pdf["cogs"] = pdf.raw_material * 1.5 + r.normal(0, 0.5, n)
    return pdf, spark.createDataFrame(pdf)


def design(pdf):
    x = pdf[["raw_material", "freight"]]
    x = x.fillna(x.median())
    return np.column_stack([((x - x.mean()) / x.std(ddof=0)).to_numpy(), *[pd.get_dummies(pdf[c]).astype(float) for c in ("region", "customer")]])


def wide_model(df, **kw):
    return train_model(df, features=["region", "customer", "raw_material", "freight"], targets=["total_revenue", "cogs"], test_size=0.0, wide_levels=5, **kw)[0]


def test_wide_fit_equals_the_dense_design(spark, data):
    pdf, df = data
    m = wide_model(df)
    assert m.wide == "customer" and m.dense == ["region"] and "customer" not in m.levels
    d = design(pdf)
    centred = d - d.mean(0)
    levels = m.wide_table.toPandas().sort_values("category")
    for y in ("total_revenue", "cogs"):
        v = pdf[y].to_numpy()
        b = np.linalg.lstsq(centred, v - v.mean(), rcond=1e-10)[0]  # the least norm
        assert np.allclose([*m.coefs["baseline", y][1], *levels[f"baseline__{y}"]], b, atol=1e-7)
        assert np.isclose(m.coefs["baseline", y][0], v.mean() - d.mean(0) @ b)
        errors = []
        for a in ALPHAS:
            h = 1 / len(d) + ((centred @ np.linalg.inv(centred.T @ centred + a * np.eye(d.shape[1]))) * centred).sum(axis=1)
            b = np.linalg.solve(centred.T @ centred + a * np.eye(d.shape[1]), centred.T @ (v - v.mean()))
            errors.append((((v - v.mean() - centred @ b) / (1 - h)) ** 2).sum())
        a = ALPHAS[int(np.argmin(errors))]
        assert m.alphas[y] == a
        b = np.linalg.solve(centred.T @ centred + a * np.eye(d.shape[1]), centred.T @ (v - v.mean()))
        assert np.allclose([*m.coefs["ridge", y][1], *levels[f"ridge__{y}"]], b, atol=1e-8)


def test_wide_and_dense_forms_score_alike_also_after_saving(spark, data, tmp_path):
    _, df = data
    wide = wide_model(df, name="w")
    dense = train_model(df, features=["region", "customer", "raw_material", "freight"], targets=["total_revenue", "cogs"], test_size=0.0)[0]
    save_model(wide, str(tmp_path / "coefs"), spark)
    loaded = load_model(spark, str(tmp_path / "coefs"), "w")
    assert loaded.wide == "customer" and loaded.alphas == wide.alphas == dense.alphas
    rows = df.unionByName(df.limit(1).withColumn("customer", F.lit("never seen"))).unionByName(df.limit(1).withColumn("customer", F.lit(None)))
    a, b, c = (sorted(map(tuple, score.score(m, rows).select("predicted_total_revenue", "predicted_cogs").collect())) for m in (wide, dense, loaded))
    assert a == c and np.allclose(a, b, atol=1e-3)
    assert not [c for c in score.score(wide, rows).columns if c.startswith("_")]


def test_split_metrics_and_many_levels(spark):
    rows = spark.range(30_000).select(
        F.date_add(F.lit("2020-01-01"), F.col("id").cast("int") % 900).alias("order_date"), F.concat(F.lit("k"), F.col("id") % 12_000).alias("customer"),
        (F.rand(3) * 9).alias("freight"), "id").withColumn("total_revenue", F.col("freight") * 2 + F.col("id") % 12_000 / 1000 + F.rand(4))
    m, metrics = train_model(rows, targets=["total_revenue"], features=["customer", "freight"], split_keys=["id"], exact_split=False)
    got = {r.model: r.R2 for r in metrics.collect()}
    assert m.wide == "customer" and m.wide_table.count() > 10_000 and got["ridge"] > 0.95
    assert not m.wide_table.is_cached
