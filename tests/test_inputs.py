"""Rules for products, and rows of an input sheet."""

import pytest
from pyspark.sql import functions as F

from pricetide.operators import catalog

GOOD = {"name": "Chair 2", "ean": "4006381333931", "sku": None, "notes": None, "own_price_cents": 1, "alert_target_price_cents": None, "alert_drop_percent_bps": None, "website_url": "https://shop.example/"}
SCHEMA = "id int, name string, ean string, sku string, notes string, own_price_cents long, alert_target_price_cents long, alert_drop_percent_bps int, website_url string"

CASES = [
    ({}, ""), ({"name": "x"}, "name"), ({"name": " x "}, "name"), ({"name": None}, "name"), ({"name": "x" * 180}, ""), ({"name": "x" * 181}, "name"), ({"ean": "4006381333932"}, "ean"), ({"ean": None}, "ean"), ({"ean": "400-6381 333931"}, ""),
    ({"sku": "s" * 80}, ""), ({"sku": "s" * 81}, "sku"), ({"notes": "n" * 500}, ""), ({"notes": "n" * 501}, "notes"), ({"own_price_cents": None}, ""), ({"own_price_cents": -1}, "own_price"), ({"own_price_cents": 10**9}, ""), ({"own_price_cents": 10**9 + 1}, "own_price"),
    ({"alert_target_price_cents": -1}, "alert_target_price"), ({"alert_target_price_cents": 0}, ""), ({"alert_drop_percent_bps": 0}, "alert_drop_percent"), ({"alert_drop_percent_bps": 10_000}, ""), ({"alert_drop_percent_bps": 10_001}, "alert_drop_percent"),
    ({"website_url": "ftp://shop.example/"}, "website"), ({"website_url": "shop.example"}, "website"), ({"website_url": "https://u:p@shop.example/"}, "website"), ({"website_url": "https://shop.example:8080/"}, "website"), ({"website_url": "https://shop.example:443/x"}, ""),
    ({"website_url": "http://10.0.0.1/"}, "website"), ({"website_url": "https://localhost/"}, "website"), ({"website_url": None}, "website"), ({"website_url": " HTTP://Shop.Example?q=1 "}, ""), ({"name": "", "ean": "1", "notes": "n" * 999}, "name,ean,notes"),
]


def test_validate(spark):
    rows = [(k, *(GOOD | changed).values()) for k, (changed, _) in enumerate(CASES)]
    got = {r["id"]: r["errors"] for r in catalog.validate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize("absent", ["sku", "notes", "alert_target_price_cents"])
def test_validate_without_a_column(spark, absent):
    rows = spark.createDataFrame([(1, *GOOD.values())], SCHEMA).drop(absent)
    assert catalog.validate(rows).first()["errors"] == "" and catalog.validate(rows.where(F.lit(False))).count() == 0
