"""Readers, sheets, and alert buckets as a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricetide.operators import alerts, catalog
from pricetide.sources import readers
from pricetide.streaming import jobs


def test_scan(spark, tmp_path):
    rows = [(1, "a", dt.datetime(2024, 1, 1)), (2, "b", dt.datetime(2024, 1, 3)), (3, "a", dt.datetime(2024, 1, 2)), (4, "a", None), (5, None, dt.datetime(2024, 1, 4))]
    spark.createDataFrame(rows, "id int, owner string, created_at timestamp_ntz").repartition(3).write.parquet(f"{tmp_path}/t")
    assert [r["id"] for r in readers.scan(spark, f"{tmp_path}/t").collect()] == [4, 5, 2, 3, 1]
    mine = readers.scan(spark, f"{tmp_path}/t", "a")
    assert [r["id"] for r in mine.collect()] == [4, 3, 1] and "EqualTo(owner,a)" in mine._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "lines, want",
    [
        (["Naziv izdelka;EAN/GTIN;Opombe;Vaša cena", "Stol;12345670;x;1,50", "Example product;12345670;;", ";12345670;;", "Miza;;;", "Omara;12-34 5671;;"], [("Stol", "12345670", 150, None, "x"), ("Omara", "12345671", None, None, "")]),
        (["title;;", "PRODUCT_NAME (required);Barcode;SKU", "Chair;0001;s 1"], [("Chair", "0001", None, "s 1", None)]),
        (["nothing;here;", "a;b;c"], []),
    ],
)
def test_sheet_headings(spark, lines, want):
    rows = spark.createDataFrame([(k, line.split(";")) for k, line in enumerate(lines)], "row_id long, cells array<string>")
    assert [tuple(r)[1:] for r in catalog.import_sheet(rows).orderBy("row_id").collect()] == want


def test_alert_buckets_as_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"r{k % 3}", f"h{k % 2}", start + dt.timedelta(minutes=11 * k), 30 * (1 + k % 3)) for k in range(600)]
    events = spark.createDataFrame(rows, "rule_id string, host string, detected_at timestamp_ntz, cooldown_minutes int")
    for part in range(3):  # three triggers, a restart between each
        events.where(F.col("detected_at").between(start + dt.timedelta(minutes=2200 * part), start + dt.timedelta(minutes=2200 * (part + 1) - 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = jobs.health_buckets(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), longest=90)
        run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        run.awaitTermination(120)
    key = lambda r: (r["rule_id"], r["host"], r["bucket"])
    got = {key(r): (r["first_detected_at"], r["raised"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = alerts.dedupe_buckets(events).collect()
    want = {key(r): (r["first_detected_at"], r["raised"]) for r in batch}
    closed = {k for k, (at, _) in want.items() if at < start + dt.timedelta(minutes=6600 - 11 - 90 * 3 - 60)}
    assert not (wrong := dict(got.items() - want.items())), (len(wrong), sorted(wrong.items())[:3], [want.get(k) for k in sorted(wrong)[:3]])
    assert not (lost := closed - got.keys()), (len(lost), sorted(want[k] for k in lost)[:3])
    assert closed <= got.keys() and len(closed) > 200 and max(n for _, n in got.values()) > 1
