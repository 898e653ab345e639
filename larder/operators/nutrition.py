"""Nutrient pivots, source choice, plate-scan foods and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed_values as fv
from larder.functions import numbers as nm
from larder.functions.text import clean_text, strip_leading_zeros
from larder.operators.scaling import keep_first, top_k

NUTRIENTS = list(dict.fromkeys(fv.NUTRIENT_FIELDS_BY_ID.values()))
MACROS = ["calories", "protein", "carbs", "fat", "sugar", "fiber"]


def nutrient_pivot(values: DataFrame, keys) -> DataFrame:
    """One row per key: the first non-null value of each nutrient, one decimal, and salt."""
    wide = values.where("value IS NOT NULL").groupBy(*keys).agg(
        *[F.min_by("value", F.when(F.col("nutrient_id") == i, F.col("pos"))).alias(f) for i, f in fv.NUTRIENT_FIELDS_BY_ID.items()]
    )
    rounded = wide.select(*keys, *[nm.js_round(f, 1).alias(f) for f in NUTRIENTS])
    return rounded.withColumn("salt", nm.salt_from_sodium("sodium"))


def best_source(records: DataFrame, key: str, priority: str) -> DataFrame:
    """The record with the most nutrients filled in; ties go to the earlier source."""
    filled = sum(F.col(f).isNotNull().cast("int") for f in fv.SCORED_NUTRIENTS)
    return keep_first(records.withColumn("filled", filled), [key], [F.desc("filled"), F.asc(priority)])


def gtin_or_first(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate whose code equals the barcode up to leading zeros, else the first one.

    ``requests`` has request_id, barcode; ``candidates`` request_id, gtin, pos.
    """
    j = requests.join(candidates, "request_id")
    match = strip_leading_zeros(F.coalesce("gtin", F.lit(""))) == strip_leading_zeros("barcode")
    return keep_first(j.withColumn("matched", match), ["request_id"], [F.desc("matched"), F.asc("pos")])


def merge_foods(foods: DataFrame, scan: str = "scan_id", pos: str = "pos") -> DataFrame:
    """Foods of a scan merged by name, ignoring case: macros added, first labels kept,
    first real portion taken. Zero calories are worked out from the macros."""
    f = foods.withColumn("name", clean_text("name", fv.UNKNOWN_FOOD)).withColumn(
        "portion", clean_text("portion", fv.NO_PORTION)
    )
    is_text = {name for name, kind in foods.dtypes if kind == "string"}
    whole = lambda c: nm.int_prefix(c) if c in is_text else F.greatest(nm.num_or_zero(c).cast("bigint"), F.lit(0))
    f = f.withColumns({c: whole(c) for c in MACROS})
    f = f.withColumn(
        "calories", F.coalesce(nm.falsy_to_null("calories"), F.expr("protein * 4 + carbs * 4 + fat * 9"))
    ).withColumn("food_key", F.lower("name"))
    real = F.when(F.col("portion") != fv.NO_PORTION, F.col(pos))
    return f.groupBy(scan, "food_key").agg(
        F.min_by("name", pos).alias("name"),
        F.coalesce(F.min_by("portion", real), F.lit(fv.NO_PORTION)).alias("portion"),
        *[F.sum(c).alias(c) for c in MACROS],
    )


def reconcile_totals(stated: DataFrame, computed: DataFrame, key: str, columns) -> DataFrame:
    """Stated totals where they agree with the computed sums, else the sums."""
    renamed = computed.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return stated.join(renamed, key).select(
        key, *[nm.reconcile(F.col(c), F.col(f"__{c}")).alias(c) for c in columns]
    )


def scan_history(scans: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user: number of earlier scans (at most 100), ten recent and six frequent foods."""
    total = scans.groupBy(user).agg(F.least(F.count("*"), F.lit(100)).alias("scan_count"))
    recent = top_k(scans, [user], [F.desc("ts"), F.desc("id")], 10, rank="r").groupBy(user).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "food"))), lambda s: s["food"]).alias("recent_foods"))
    counts = scans.groupBy(user, "food").count()
    frequent = top_k(counts, [user], [F.desc("count"), F.asc("food")], 6, rank="r").groupBy(user).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "food"))), lambda s: s["food"]).alias("frequent_foods"))
    return total.join(recent, user, "left").join(frequent, user, "left")
