"""Work that is done once: what reads a result again reads files."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_ledger_date
from ledgerlens.functions.once import select_once
from ledgerlens.operators import rollup, split, whatif
from ledgerlens.operators.medians import exact_medians
from ledgerlens.plans import catalog
from ledgerlens.sources import ledger_csv, testdata


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_days_and_splits_are_read_from_files(spark):
    led = spark.range(90).select(F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 9).cast("int")).alias("order_date"),
                                 F.concat(F.lit("r"), F.col("id") % 2).alias("region"), F.col("id").cast("double").alias("cogs"))
    daily = rollup.daily_rollup(led)
    assert "Aggregate" not in plan(daily) and daily.agg(F.sum("cogs")).first()[0] == 4005.0
    assert "Range" not in plan(split.exact_split(led, ["order_date"], 0.25, 1))


def test_latest_row_among_equal_and_dateless_rows(spark):
    d = dt.date
    rows = [(None, 9, 5.0), (d(2024, 1, 1), 9, 1.0), (d(2024, 1, 2), None, 2.0), (d(2024, 1, 2), 3, 4.0), (d(2024, 1, 2), 3, 4.0)]
    df = spark.createDataFrame(rows, "order_date date, k int, freight double")
    out = whatif.replace_latest(df, ["order_date", "k"], {"freight": -1.0})
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rows[:4] + [(d(2024, 1, 2), 3, -1.0)]))
    assert "struct" not in plan(out)                      # no row is compared whole
    state = whatif.WhatIfState.build(df, ["k", "freight"], ["order_date", "k"])
    assert state.repeats == 2 and state.latest == {"k": 3.0, "freight": 4.0}
    assert exact_medians(df, [], ["freight"]).first()[0] == 4.0


def test_parsed_values_are_computed_once(spark):
    df = spark.createDataFrame([("2024-01-05 10:00",), ("20240106",), ("2024/1",), ("3-2024",), ("x",)], "t string")
    once = select_once(df, [parse_ledger_date("t").alias("d")]).where("d is not null")
    assert [str(r.d) for r in once.collect()] == ["2024-01-05", "2024-01-06", "2024-01-01", "2024-03-01"]
    plain = plan(df.select(parse_ledger_date("t").alias("d")))
    assert plan(once).count("RLIKE") == plain.count("RLIKE") > 0


def test_quoted_ledger_text_is_read_from_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Order Date,Customer,COGS\n2024-01-01,"a, b",1\n2024-01-02,c,2\n')
    raw = ledger_csv.read_ledger_csv(spark, str(tmp_path / "l.csv"))
    assert "MapInArrow" not in plan(raw) and [r.customer for r in raw.orderBy("row_no").collect()] == ["a, b", "c"]


def _tables(spark, root):
    made = {"lineitem": (40, ["id div 4 as l_orderkey", "id % 6 as l_partkey", "cast(id % 4 as int) as l_linenumber", "cast(id % 7 as double) as l_quantity",
                              "id * 10.1D as l_extendedprice", "if(id % 9 = 0, null, 0.07D) as l_discount", "0.03D as l_tax"]),
            "orders": (11, ["id as o_orderkey", "id % 3 as o_custkey", "timestamp_seconds(860000000 + id * 604800) as o_orderdate"]),
            "customer": (3, ["id as c_custkey", "id % 2 as c_nationkey", "concat('m', id) as c_mktsegment"]),
            "part": (5, ["id as p_partkey", "concat('t', id % 2) as p_type", "cast(id + 1 as int) as p_size", "id + 0.1D as p_retailprice"]),
            "nation": (2, ["id as n_nationkey", "concat('n', id) as n_name", "id as n_regionkey"]),
            "region": (2, ["id as r_regionkey", "if(id = 0, 'ASIA', 'EUROPE') as r_name"])}
    for name, (n, cols) in made.items():
        spark.range(n).selectExpr(*cols).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_written_ledger_holds_the_tables_numbers_alone(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    rows = lambda df: sorted(map(str, df.collect()))
    led, made = catalog._written_ledger(spark, sf), testdata.ledger(spark, sf)
    assert led.dtypes == made.dtypes and rows(led) == rows(made) and len(rows(made)) == 34
    held = spark.read.parquet(*led.inputFiles()).columns
    assert "l_extendedprice" in held and not {"cogs", "freight", "total_revenue"} & set(held)
    costs = catalog._segment_costs(spark, sf)
    assert rows(costs) == rows(made.select(*costs.columns))


def test_line_items_are_not_sorted_for_orders(spark, tmp_path):
    made = testdata.ledger(spark, _tables(spark, tmp_path))
    assert "shuffle_hash" in made._jdf.queryExecution().optimizedPlan().toString()
