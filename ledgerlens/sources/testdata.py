"""Conformed views over the driver's TPC-H-ish tables (FIXTURES part B).

``ledger`` maps lineitem/orders/customer/nation/region/part onto the clean
ledger schema; ``factors`` derives one row of six macro factors per ship
month (February, June and October left out on purpose, so that gap months
are exercised).  Both are lazy DataFrames: Catalyst prunes the columns and
picks the join strategies from the table sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import COSTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean ledger row per lineitem (60,000 rows at sf0.01)."""
    return clean_ledger(ledger_lines(spark, sf_dir))


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined rows of the ledger with the numbers of the tables, of which
    ``clean_ledger`` makes its costs and totals.

    Orders meet their customers before the line items do, and the names of
    nations and regions come last, by a join of a few rows: line items are
    shuffled for orders and parts alone, with keys in place of names.  Orders
    are the hashed side of their join, so line items are not sorted for it and
    a large share of them in one task doesn't spill."""
    l = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")

    geo_of = (F.when(F.col("r_name") == "ASIA", "APAC")
              .when(F.col("r_name") == "AMERICA", "AMER").otherwise("EMEA"))
    nations = (n.join(r, n.n_regionkey == r.r_regionkey)
               .select("n_nationkey", F.col("r_name").alias("region"), geo_of.alias("geo"), F.col("n_name").alias("country")))
    oc = (o.join(c, o.o_custkey == c.c_custkey)
          .select("o_orderkey", "o_orderdate", "c_nationkey", F.col("c_mktsegment").alias("customer")))
    j = (l.join(oc.hint("shuffle_hash"), l.l_orderkey == oc.o_orderkey).drop("o_orderkey")
         .join(p, l.l_partkey == p.p_partkey)
         .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select(
        F.to_date("o_orderdate").alias("order_date"), "l_orderkey", "l_linenumber",
        "region", "geo", "country", F.col("p_type").alias("item_type"), "customer",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice")


def clean_ledger(lines: DataFrame) -> DataFrame:
    """The clean ledger schema over ``ledger_lines``: each column from its own
    row, so rows that were written and read again give the same ledger."""
    qty, price = F.col("l_quantity"), F.col("l_extendedprice")
    out = lines.select(
        "order_date",
        F.trunc("order_date", "MM").alias("month"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        "region", "geo", "country", "item_type", "customer",
        (price * (1 - F.col("l_discount"))).alias("total_revenue"),
        (F.col("p_retailprice") * qty * 3 / 10).alias("raw_material"),
        (qty * 25 / 2).alias("direct_labor"),
        (price / 50).alias("freight"),
        (F.col("p_size").cast("double") * 3).alias("storage"),
        (qty * 7 / 4).alias("packaging"),
        (qty * F.col("p_size") / 20).alias("indirect_labor"),
        (price * F.col("l_tax") / 10).alias("rent_utility"),
        (F.col("l_linenumber").cast("double") * 9).alias("overhead"),
        (price * F.col("l_tax")).alias("sga"),
    )
    cogs = sum((F.col(c) for c in COSTS[1:]), F.col(COSTS[0]))
    return (out.withColumn("cogs", cogs)
            .withColumn("gross_profit", F.col("total_revenue") - F.col("cogs")))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly factor table: ``month`` unique, six DOUBLE factors."""
    l = table(spark, sf_dir, "lineitem")
    month = F.trunc(F.to_date("l_shipdate"), "MM")
    return (l.where(~F.month("l_shipdate").isin(2, 6, 10))
            .groupBy(month.alias("month"))
            .agg((F.avg("l_discount") * 1000).alias("cci"),
                 (F.avg("l_tax") * 100).alias("cpi"),
                 F.avg("l_quantity").alias("oil"),
                 (F.sum("l_extendedprice") / 1000000).alias("gdp"),
                 F.avg(F.when(F.col("l_returnflag") == "R", 100).otherwise(0)).alias("unemployment"),
                 (F.avg(F.col("l_extendedprice") * F.col("l_discount")) / 100).alias("roi")))


# ---------------------------------------------------------------------------
# catalogue tables derived from the driver tables (FIXTURES part B)
# ---------------------------------------------------------------------------
def ingestion_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"),
        F.col("o_orderstatus").alias("status"))


def file_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    ftype = (F.when(F.col("l_returnflag") == "N", "SUBLEDGER")
             .when(F.col("l_returnflag") == "R", "FACTORS").otherwise("OTHER"))
    path = F.when(F.col("l_linestatus") == "O",
                  F.concat_ws("/", F.lit("uploads"), F.col("l_orderkey").cast("string"),
                              F.concat(F.col("l_partkey").cast("string"), F.lit(".csv"))))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                    F.col("l_orderkey").alias("batch_id"), ftype.alias("file_type"),
                    path.alias("file_path"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("user_id"),
                    F.concat(F.col("c_name"), F.lit(".csv")).alias("original_filename"),
                    F.sha2(F.col("c_name"), 256).alias("file_hash"),
                    F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int"))
                    .alias("uploaded_at"))


def trained_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dataset_id"),
        F.col("c_nationkey").cast("long").alias("user_id"),
        F.concat(F.lit("m_"), F.col("o_orderkey").cast("string")).alias("model_name"),
        F.to_date("o_orderdate").alias("trained_at"), F.col("o_orderstatus").alias("status"))
