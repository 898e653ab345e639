"""JSON url maps and seed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_url_map(links: DataFrame, path: str) -> None:
    """Store the distinct urls of each store, one JSON line per url, foldered by store.

    A store may own most of the links, so they are never gathered into one array.
    """
    links.select("store", "url").distinct().write.partitionBy("store").json(path)


def read_url_map(spark: SparkSession, path: str, store: str | None = None) -> DataFrame:
    """Read a stored url map; naming a store prunes the scan to its folder."""
    links = spark.read.schema("url STRING, store STRING").json(path)
    return links.where(F.col("store") == store) if store else links


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """Read a small hand-kept file of the form {store: [url, ...]} as (store, url) rows."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string, array<string>>")
    return raw.select(F.explode(parsed).alias("store", "urls")).select("store", F.explode("urls").alias("url"))


def url_seeds(spark: SparkSession, seeds: dict[str, list[str]]) -> DataFrame:
    rows = [(store, url) for store, urls in seeds.items() for url in urls]
    return spark.createDataFrame(rows, "store string, url string")
