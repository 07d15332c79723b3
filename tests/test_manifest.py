"""Stores with optimistic commits, with writers at the same time."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import pipelines
from ledgerlens.sources import factor_store
from ledgerlens.sources.manifest import Conflict, Store, claim, read_text, release


def test_one_of_many_claims_succeeds(spark, tmp_path):
    path = f"{tmp_path}/claims/name"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: claim(spark, path, f"writer {k}"), range(8)))
    assert sum(won) == 1 and read_text(spark, path) == f"writer {won.index(True)}"
    release(spark, path)
    assert read_text(spark, path) is None and claim(spark, path)


def test_two_writers_lose_no_update(spark, tmp_path):
    """Each writer adds its month to the same company's factors."""
    def add(k):
        new = spark.createDataFrame([(dt.date(2021, 1 + k, 1), float(k))], "month date, cpi double")
        factor_store.update_company_factors(
            spark, f"{tmp_path}/s", 7, lambda old: new if old is None else old.select("month", "cpi").unionByName(new))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(add, range(3)))
    assert {r.month.month: r.cpi for r in factor_store.load_company_factors(spark, f"{tmp_path}/s", 7).collect()} == {1: 0.0, 2: 1.0, 3: 2.0}


def test_versions_stay_whole_until_expired(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.version() == 0 and store.read("a") is None
    store.commit("a", lambda old: spark.range(3))
    before = store.read("a")                              # resolved, not yet run
    store.commit("b", lambda old: spark.range(1))
    assert store.commit("a", lambda old: old.where(F.col("id") > 0)) == 3
    assert before.count() == 3 and store.read("a").count() == 2 and store.read("a", 2).count() == 3
    assert store.commit("b", lambda old: None) == 4 and store.read("b") is None and store.read("a").count() == 2
    assert store.expire(keep=1) == 2 and store.read("a").count() == 2 and set(store.parts()) == {"a"}


def test_failed_changes_leave_the_store(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/s")
    store.commit("a", lambda old: spark.range(3))
    with pytest.raises(ValueError):
        pipelines.factor_refresh(spark, f"{tmp_path}/s", 1, "2020-01-01", {})
    monkeypatch.setattr("ledgerlens.sources.manifest.claim", lambda *a: False)
    with pytest.raises(Conflict):
        store.commit("a", lambda old: spark.range(9), attempts=2)
    assert store.version() == 1 and store.read("a").count() == 3


def test_trainings_at_once_keep_names_ids_and_files_unique(spark, tmp_path):
    rows = "".join(f"2021-{1 + i % 12:02d}-{1 + i % 28:02d},{100 + 3 * i},{50 + i % 9},{10 + i % 7},{20 + i}\n" for i in range(60))
    path, root = f"{tmp_path}/u.csv", f"{tmp_path}/r"
    with open(path, "w") as f:
        f.write("Order Date,Total Revenue,COGS,SG&A,Freight\n" + rows)

    def run(name):
        try:
            return pipelines.train_upload(spark, path, root, 3, name)
        except ValueError as e:
            return str(e)

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(run, ["m1", "m1", "m2"]))
    assert sorted(isinstance(g, str) for g in got) == [False, False, True]
    made = [g for g in got if not isinstance(g, str)]
    assert len({g["dataset_id"] for g in made}) == 1 and sum(g["is_new_dataset"] for g in made) == 1 and len({g["model_id"] for g in made}) == 2
    assert spark.read.parquet(f"{root}/datasets").count() == 1
    assert sorted(r.model_name for r in spark.read.parquet(f"{root}/models").collect()) == ["m1", "m2"]
    assert {r.model_name for r in spark.read.parquet(f"{root}/coefs").select("model_name").distinct().collect()} == {"m1", "m2"}
    with pytest.raises(ValueError, match="no row"):        # a failed training gives its name back
        open(f"{tmp_path}/bad.csv", "w").write("Order Date,Total Revenue,COGS,SG&A\nx,1,1,1\n")
        pipelines.train_upload(spark, f"{tmp_path}/bad.csv", root, 3, "m3")
    with pytest.raises(ValueError, match="no row"):
        pipelines.train_upload(spark, f"{tmp_path}/bad.csv", root, 3, "m3")
