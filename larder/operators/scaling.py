"""Building blocks that keep plans safe when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def top_k(df: DataFrame, keys, order, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each key.

    Written as row_number() <= k so that Spark places a group limit below the
    shuffle: each task forwards at most ``k`` rows of a key, however hot it is.
    """
    name = rank or "__rank"
    w = Window.partitionBy(*as_cols(keys)).orderBy(*as_cols(order))
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first by ``order`` (same group limit as top_k)."""
    return top_k(df, keys, order, 1)


def add_kept(df: DataFrame, name: str, value: Column, test) -> DataFrame:
    """Add column ``name`` and keep the rows where ``test(column)`` holds.

    The value is worked out once. With a plain where() the optimizer moves the test
    below the projection and evaluates a costly value a second time.
    """
    return df.withColumn(name, F.explode(F.filter(F.array(value), test)))


def one_in(n: int, key: str) -> Column:
    """True for about one key in ``n``, the same ones in every table."""
    return F.pmod(F.xxhash64(key), F.lit(n)) == 0


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt over at least two tasks a core.

    For narrow rows of a small file, which Spark reads in one task, before costly work on each row.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
