"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark
decontamination, mixing sources to target weights.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and reread as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, line_dedup, mixing, quality, simhash
from ledgerlens.llm.common import materialise, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.drop_low_quality(docs)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; n_chars follows the new text."""
    made = line_dedup.drop_common_lines(docs)
    return made.select(*[F.col("kept_text").alias("text") if c == "text" else
                         F.length("kept_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c)
                         for c in docs.columns])


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.drop_near_duplicates(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks, with their place in the mix."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("simhash_near_dedup", stage_simhash),
    ("benchmark_decontamination", stage_decontamination),
    ("source_mixing", stage_mixing),
]

#: The fingerprints' XXH64 and the search for links have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
