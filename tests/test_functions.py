"""Scalar expressions: money / factor text, dates, calendar features."""

import datetime as dt
import math

from pyspark.sql import functions as F

from ledgerlens.functions import (calendar_features, date_from_year_mo, missing_to_null,
                                  parse_factor_date, parse_ledger_date, to_factor_number, to_number)


def one_col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v")).alias("x")).collect()]


def test_money_scrub(spark):
    got = one_col(spark, ["$1,234.50", " 7 ", "", "abc", "NaN", "NA", None, "-3"], to_number)
    assert got[:2] == [1234.5, 7.0]
    assert got[2:7] == [None] * 5
    assert got[7] == -3.0


def test_factor_scrub(spark):
    assert one_col(spark, ["4.1 %", "$52.16", " 1,000 ", "x"], to_factor_number) == [4.1, 52.16, 1000.0, None]


def test_missing_tokens(spark):
    assert one_col(spark, [" a ", "N/A", "null", "None", "", "nan"], missing_to_null) == \
        ["a", None, None, None, None, None]


def test_ledger_dates(spark):
    vals = ["2021-01-09", "2021-01-09 00:00:00", "01/02/2020", "13/02/2020", "Jan-20", "Jan-2020",
            "Jan 2020", "2020-01", "02-2020", "02/2020", "31-12-2020", "garbage", "", None]
    got = one_col(spark, vals, parse_ledger_date)
    d = dt.date
    assert got == [d(2021, 1, 9), d(2021, 1, 9), d(2020, 1, 2), d(2020, 2, 13), d(2020, 1, 1),
                   d(2020, 1, 1), d(2020, 1, 1), d(2020, 1, 1), d(2020, 2, 1), d(2020, 2, 1),
                   d(2020, 12, 31), None, None, None]


def test_every_date_form(spark):
    """Month first for slashes, dashes and dots; ISO, compact, textual months."""
    d = dt.date
    want = {"2021-01-09T10:11:12.345Z": d(2021, 1, 9), "2021-01-09 10:11": d(2021, 1, 9), "2021/01/09": d(2021, 1, 9), "20210109": d(2021, 1, 9),
            "Jan 9, 2021": d(2021, 1, 9), "9 Jan 2021": d(2021, 1, 9), "09-Jan-2021": d(2021, 1, 9), "January 9 2021": d(2021, 1, 9),
            "1/2/21": d(2021, 1, 2), "12/31/99": d(1999, 12, 31), "05-03-2021": d(2021, 5, 3), "13-02-2021": d(2021, 2, 13), "05.03.2021": d(2021, 5, 3),
            "Sept 2020": d(2020, 9, 1), "2021-02-30": None, "13-13-2020": None, "2021-13-01": None}
    assert dict(zip(want, one_col(spark, list(want), parse_ledger_date))) == want


def test_factor_dates_mon_yy_first(spark):
    assert one_col(spark, ["Mar-21", "2021-03-15", "March 2021"], parse_factor_date) == \
        [dt.date(2021, 3, 1), dt.date(2021, 3, 15), dt.date(2021, 3, 1)]


def test_year_mo(spark):
    df = spark.createDataFrame([("2021", "3"), ("x", "3"), ("2021", "13")], "y string, m string")
    got = [r[0] for r in df.select(date_from_year_mo("y", "m")).collect()]
    assert got == [dt.date(2021, 3, 1), None, None]


def test_calendar_features(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 3, 4),)], "d date")
    rows = df.select(*[e.alias(k) for k, e in calendar_features("d").items()]).collect()
    a, b = rows
    assert (a.year, a.month_no, a.day, a.quarter, a.is_month_end, a.is_month_start) == (2024, 2, 29, 1, 1, 0)
    assert a.day_of_week == 3                      # Thursday, Monday = 0
    assert b.day_of_week == 0
    assert math.isclose(a.month_sin, math.sin(2 * math.pi * 2 / 12))
    assert math.isclose(b.day_of_week_cos, 1.0)
