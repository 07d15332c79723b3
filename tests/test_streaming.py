"""Streaming ingestion: files in a folder -> cleaned stream -> region totals."""

import datetime as dt
import os
import tempfile

from ledgerlens.streaming.ingest import ledger_stream, region_totals_stream

HEADERS = ["Order Date", "Region", "Total Revenue", "COGS", "SG&A"]


def test_stream_region_totals(spark):
    d = tempfile.mkdtemp(prefix="ledgerlens-stream-")
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write(",".join(HEADERS) + "\n2021-01-09,EMEA,\"$1,000\",10,1\n2021-02-03,,5,1,1\nbad,EMEA,1,1,1\n")
    fac = spark.createDataFrame([(dt.date(2021, 1, 1), 1.0)], "month date, cci double")
    s = region_totals_stream(ledger_stream(spark, d, HEADERS, fac))
    q = s.writeStream.format("memory").queryName("ll_region_totals").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {r.region: (r.total_revenue, r.row_count) for r in spark.sql("select * from ll_region_totals").collect()}
    finally:
        q.stop()
    assert got == {"EMEA": (1000.0, 1), "Unknown": (5.0, 1)}
