"""Checked pages are taken out of their batches one at a time."""

from larder.sources import html


def test_contracts_of_null_and_long_pages(spark):
    long = "<nav>" + "<li>x</li>" * 5 + "</nav>" + "é" * 100_000
    pages = spark.createDataFrame([("en", long), ("en", None), ("fr", long), (None, long)], "site string, html string")
    checks = {"en": [("items", "nav li", 3)], "xx": [("images", "img", 1)]}
    assert {tuple(r) for r in html.site_contracts(pages, checks).collect()} == {("en", "items", 1, 1), ("xx", "images", 0, 0)}


def test_contracts_copy_no_batch(spark, monkeypatch):
    pages = spark.createDataFrame([("en", "<p>a</p>")], "site string, html string")
    monkeypatch.setattr(type(pages), "mapInPandas", None)  # it holds every page of a batch as a second, wider copy
    assert html.site_contracts(pages, {"en": [("p", "p", 1)]}).collect()[0].passed == 1
