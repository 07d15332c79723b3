"""Quoted CSV: records over splits against pandas, states against the csv module."""

import csv
import io
import random
import re

import pandas as pd
import pytest

from ledgerlens.sources import ledger_csv, quoted_csv


def messy(seed, rows):
    """Records whose fields hold quotes, commas, line ends and blanks."""
    r = random.Random(seed)
    pick = ["plain", 'Acme ""Best"", Ltd', "Two\nlines", "", '"', "a,b", " x ", "\n\n,\n", "é\r\nü", 'end"', "long " * 9, "5 ft"]
    return [[str(k), *("".join(r.choice(pick) for _ in range(r.randrange(3))) for _ in range(3))] for k in range(rows)]


def written(path, rows, **kw):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, **kw)
        w.writerow(["Id", "Customer", "Item type", "Note"])
        w.writerows(rows)


@pytest.mark.parametrize("split", [40, 333, 1 << 20])
def test_records_over_splits_equal_pandas(spark, tmp_path, split):
    for k in range(3):
        written(tmp_path / f"{k}.csv", messy(k, 60 + 40 * k), lineterminator="\r\n" if k == 1 else "\n", quoting=csv.QUOTE_ALL if k == 2 else csv.QUOTE_MINIMAL)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = quoted_csv.read_quoted_csv(spark, str(tmp_path))
        assert split > 40 or got.select("_at.start").distinct().count() > 20
        rows = [tuple(r)[:4] for r in got.orderBy("_at").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    want = [t for k in range(3) for t in pd.read_csv(tmp_path / f"{k}.csv", dtype=str, keep_default_na=False).itertuples(index=False, name=None)]
    assert rows == want


def test_ledger_keeps_rows_with_quoted_text(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text('﻿Order Date,Customer,Total Revenue,\n2024-01-01,"Acme ""Best"", Ltd","1,200.50",x\n\n'
                 '2024-01-02,"Two\nlines",7,y\n2024-01-03,5" pipe,8,z\n2024-01-04,"ab"cd,9\n', encoding="utf-8")
    raw = ledger_csv.read_ledger_csv(spark, str(p))
    rows = ledger_csv.clean_ledger(raw, for_training=False).orderBy("row_no").collect()
    assert [(r.customer, r.total_revenue) for r in rows] == [('Acme "Best", Ltd', 1200.5), ("Two\nlines", 7.0), ('5" pipe', 8.0), ("abcd", 9.0)]


def test_unclosed_quotes_are_an_error_and_empty_files_are_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Customer\n1,"open\n2,b\n')
    with pytest.raises(Exception, match="not closed"):
        quoted_csv.read_quoted_csv(spark, str(tmp_path / "a.csv")).collect()
    (tmp_path / "b.csv").write_text('')
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path / "b.csv")).collect() == []
    (tmp_path / "c.csv").write_text('"Id",Customer\n')
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path / "c.csv")).columns == ["Id", "Customer", "_at"]


def test_states_are_those_of_the_csv_module():
    r = random.Random(3)
    for _ in range(4000):
        line = "".join(r.choice('a",') for _ in range(r.randrange(9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line
            # a reader that is still inside a field takes the next line, too
            records = list(csv.reader(io.StringIO(text + "\nnext", newline="")))
            assert quoted_csv.state_after(line, inside) == (len(records) == 1 and "next" in records[0][-1]), (line, inside)


def test_records_within_a_split_are_parsed_where_they_are_read(spark, tmp_path, monkeypatch):
    """Only the lines over the ends of splits are written and brought together."""
    rows = [[str(k), "Two\nlines, " + str(k), "x", ""] for k in range(3000)]
    written(tmp_path / "a.csv", rows)
    tables, old = {}, quoted_csv.materialise
    monkeypatch.setattr(quoted_csv, "materialise", lambda df, tag: tables.setdefault(tag, old(df, tag)))
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = quoted_csv.read_quoted_csv(spark, str(tmp_path / "a.csv"))
        splits = tables["csv-splits"].count()
        assert splits > 3 and tables["csv-lines"].where("kind <> 0").count() <= 8 * splits
        assert [list(r)[:4] for r in got.orderBy("_at").collect()] == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf[0])
        spark.conf.set("spark.sql.files.openCostInBytes", conf[1])


def test_odd_lines_of_quoted_files(spark, tmp_path):
    """Carriage returns within lines, blank lines, short and long records."""
    (tmp_path / "a.csv").write_bytes(b'\n  \r\n"Id",Name,Note\r\n1,a\rb,"c"\r\n2,a\rb,c\n\n  \n3,"x\ry",z,more\n4,"only"\n"",,\n')
    got = [list(r)[:3] for r in quoted_csv.read_quoted_csv(spark, str(tmp_path / "a.csv")).orderBy("_at").collect()]
    assert got == [["1", "a", None], ["2", "a\rb", "c"], ["3", "x\ry", "z"], ["4", "only", None], ["", "", ""]]


def test_cleaning_generates_methods_short_enough_to_be_compiled(spark):
    raw = spark.createDataFrame([("2024-01-01", "Acme", "1,200.50", "3", "4")], "`Order Date` string, Customer string, `Total Revenue` string, COGS string, `SG&A` string")
    clean = ledger_csv.clean_ledger(raw)
    code = spark._jvm.PythonSQLUtils.explainString(clean._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
    assert [tuple(r)[1:] for r in clean.collect()] == [("Acme", 1200.5, 3.0, 4.0)]
