"""Catalogue tables as ordinary DataFrames.

Batches, uploads, datasets and models are tables; every lookup is a join,
semi / anti join or grouped aggregate, so listings for all users are one
job, and a user or batch holding a third of the rows is combined map-side.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def resolve_batch_files(batches: DataFrame, uploads: DataFrame, file_type: str = "SUBLEDGER",
                        company_id=None, batch_id=None) -> DataFrame:
    """For each batch (optionally one company / batch: the tenant
    check), the first upload of ``file_type`` with a path, by upload id."""
    b = batches
    if company_id is not None:
        b = b.where(F.col("company_id") == company_id)
    if batch_id is not None:
        b = b.where(F.col("id") == batch_id)
    u = uploads.where((F.col("file_type") == file_type) & F.col("file_path").isNotNull())
    j = b.select(F.col("id").alias("batch_id"), "company_id").join(u, "batch_id")
    return (j.groupBy("batch_id", "company_id")
            .agg(F.min_by(F.struct("id", "file_path"), F.struct("id", "file_path")).alias("_u"))
            .select("batch_id", "company_id", F.col("_u.id").alias("upload_id"),
                    F.col("_u.file_path").alias("file_path")))


def fingerprint_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SHA-256 of the raw bytes and size of each file (path, file_name,
    file_size_bytes, file_hash).  A task streams its file through the digest,
    so a file's size doesn't matter; every executor must see the paths."""
    def digest(batches):
        for b in batches:
            rows = []
            for p in b["path"]:
                h, n = hashlib.sha256(), 0
                with open(p, "rb") as f:
                    while chunk := f.read(1 << 20):
                        h.update(chunk)
                        n += len(chunk)
                rows.append((p, p.rsplit("/", 1)[-1], n, h.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "file_name", "file_size_bytes", "file_hash"])

    return (spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
            .mapInPandas(digest, "path string, file_name string, file_size_bytes long, file_hash string"))


def register_datasets(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """A candidate ``(user_id, file_hash)`` is new only when that
    pair is absent and no candidate of a lower id has it; reports
    ``is_new_dataset`` for every candidate."""
    keys = ["user_id", "file_hash"]
    seen = existing.select(*keys).distinct().withColumn("_seen", F.lit(True))
    first = candidates.groupBy(*keys).agg(F.min("id").alias("_first"))
    return (candidates.join(seen, keys, "left").join(first, keys, "left")
            .withColumn("is_new_dataset", F.col("_seen").isNull() & (F.col("id") == F.col("_first"))).drop("_seen", "_first"))


def append_datasets(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """The registry with the new candidates in it; columns a candidate
    lacks are NULL."""
    new = register_datasets(existing, candidates).where("is_new_dataset").drop("is_new_dataset")
    return existing.unionByName(new, allowMissingColumns=True)


def model_counts(models: DataFrame) -> DataFrame:
    return models.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("model_count"))


def list_datasets(datasets: DataFrame, models: DataFrame, user_id=None) -> DataFrame:
    """Datasets with their model count (0 when none),
    newest first (id breaks ties); all users unless ``user_id`` is given."""
    d = datasets if user_id is None else datasets.where(F.col("user_id") == user_id)
    c = model_counts(models).withColumnRenamed("dataset_id", "id")
    return (d.join(c, "id", "left")
            .withColumn("model_count", F.coalesce("model_count", F.lit(0)).cast("long"))
            .orderBy(F.desc("uploaded_at"), F.desc("id")))


def get_dataset(datasets: DataFrame, models: DataFrame, dataset_id) -> DataFrame:
    """One dataset with its model count."""
    return list_datasets(datasets.where(F.col("id") == dataset_id), models)


def list_models(models: DataFrame, user_id=None, dataset_id=None) -> DataFrame:
    """Models, optionally of one user / dataset, newest first."""
    m = models
    if user_id is not None:
        m = m.where(F.col("user_id") == user_id)
    if dataset_id is not None:
        m = m.where(F.col("dataset_id") == dataset_id)
    return m.orderBy(F.desc("trained_at"), F.desc("id"))


def get_model(models: DataFrame, model_id) -> DataFrame:
    """One model by id."""
    return models.where(F.col("id") == model_id)


def rank_models_per_user(models: DataFrame) -> DataFrame:
    """O1 for every user at once: position of each model in its user's
    newest-first listing.  A user's models are counted by date, the dates (not
    the models) of a user are added up, and only the models of one date are
    ordered together."""
    dates = models.groupBy("user_id", "trained_at").agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy("user_id").orderBy(F.desc("trained_at")).rowsBetween(Window.unboundedPreceding, -1)
    dates = dates.select(F.col("user_id").alias("_u"), F.col("trained_at").alias("_t"), F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before"))
    day = Window.partitionBy("user_id", "trained_at").orderBy(F.desc("id"))
    ranked = models.withColumn("_in", F.row_number().over(day))
    return (ranked.join(dates, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("trained_at").eqNullSafe(F.col("_t")))
            .select(*models.columns, (F.col("_before") + F.col("_in")).cast("int").alias("position")))


def register_models(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Model names are globally unique: a candidate name already in the
    registry is rejected; duplicates among candidates keep the lowest id."""
    taken = existing.select("model_name").distinct()
    fresh = candidates.join(taken, "model_name", "left_anti")
    return (fresh.groupBy("model_name")
            .agg(F.min_by(F.struct(*[c for c in candidates.columns if c != "model_name"]), F.col("id"))
                 .alias("_m"))
            .select("model_name", "_m.*"))


def remove_models(models: DataFrame, removed_ids: DataFrame) -> DataFrame:
    """Registry without the removed ids (their coefficient partitions are
    dropped by the model store)."""
    return models.join(removed_ids.select("id").distinct(), "id", "left_anti")


def profile_dataset(ledger: DataFrame) -> DataFrame:
    """Row count, column list, order-date range, targets present."""
    from ledgerlens.schema import TARGETS
    targets = ",".join(t for t in TARGETS if t in ledger.columns)
    return ledger.agg(F.count(F.lit(1)).alias("row_count"),
                      F.min("order_date").alias("date_range_start"),
                      F.max("order_date").alias("date_range_end")).select(
        "row_count", F.lit(",".join(ledger.columns)).alias("column_names"),
        "date_range_start", "date_range_end", F.lit(targets).alias("target_columns"))
