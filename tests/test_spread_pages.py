"""Pages built from one small file are parsed by all cores."""

import pandas as pd
from pyspark.sql import functions as F

from larder.plans.scans import html_card_extract
from larder.sources import html, tables


def parts(spark, tmp_path):
    rows = pd.DataFrame({"p_partkey": range(400), "p_name": [f"name {k}" for k in range(400)], "p_size": 3, "p_brand": "Brand#1"})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def used(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_listing_pages_are_spread(spark, tmp_path):
    pages = tables.store_pages(spark, parts(spark, tmp_path))
    assert pages.count() == 400 and used(pages) > 1
    assert used(html.raw_cards(pages)) > 1


def test_product_pages_are_spread(spark, tmp_path):
    cards = html_card_extract(spark, parts(spark, tmp_path))
    assert cards.count() == 400 and used(cards) > 1
