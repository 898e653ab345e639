"""Table maintenance: upserts, conditional inserts, deletes, nested merges.

Each function takes whole tables of changes and whole target tables and returns
the new table; nothing is applied row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.scaling import as_cols, keep_first


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order=None, keep=()) -> DataFrame:
    """Replace supplied fields of known keys and insert unknown keys.

    A column that ``changes`` has is supplied, null included: the last change of a key sets it. Columns that
    ``changes`` lacks keep their old value.

    One aggregation, no join: rows of both sides are tagged and reduced per key
    with map-side combine, so a key repeated in a third of the changes does not
    gather in one task. ``order`` decides between changes of one key (last wins);
    ``keep`` names columns that stay as first inserted.
    """
    values = [c for c in target.columns if c not in keys]
    order = order or [F.lit(0)]
    old = target.select(*keys, *values, F.struct(F.lit(0).alias("new"), _null_order(changes, order)).alias("__rank"))
    new = changes.select(
        *keys,
        *[F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in values],
        F.struct(F.lit(1).alias("new"), F.struct(*as_cols(order)).alias("at")).alias("__rank"),
    )
    both = old.unionByName(new)
    picked = []
    for c in values:
        if c in keep:
            pick = F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__rank")))
        elif c in changes.columns:
            pick = F.max_by(c, "__rank")
        else:
            pick = F.max_by(c, F.when(F.col("__rank.new") == 0, F.col("__rank")))
        picked.append(pick.alias(c))
    return both.groupBy(*keys).agg(*picked).select(*target.columns)


def _null_order(changes: DataFrame, order) -> Column:
    shape = changes.select(F.struct(*as_cols(order)).alias("at")).schema["at"].dataType
    return F.lit(None).cast(shape).alias("at")


def insert_if_absent(target: DataFrame, candidates: DataFrame, keys: list[str], order) -> DataFrame:
    """Candidates whose key is unseen, one per key; returns (row, outcome) for all of them.

    Outcome is 'added' for the first unseen candidate of a key and 'skipped' else.
    """
    seen = target.select(*keys).distinct().withColumn("__seen", F.lit(True))
    first = candidates.groupBy(*keys).agg(F.min(F.struct(*as_cols(order))).alias("__first"))
    known = first.join(seen, keys, "left")
    tagged = candidates.join(known, keys)
    added = F.col("__seen").isNull() & (F.struct(*as_cols(order)) == F.col("__first"))
    return tagged.withColumn("outcome", F.when(added, "added").otherwise("skipped")).drop("__seen", "__first")


def fill_missing(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill columns that are null, 0 or '' from ``updates`` (one row per key)."""
    renamed = updates.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = target.join(renamed, key, "left")
    for c in columns:
        empty = F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0")
        joined = joined.withColumn(c, F.when(empty & F.col(f"__new_{c}").isNotNull(), F.col(f"__new_{c}")).otherwise(F.col(c)))
    return joined.select(*target.columns)


def replace_upsert(rows: DataFrame, keys: list[str], order) -> DataFrame:
    """Whole-row upsert on a unique key: the last row of each key stays."""
    return keep_first(rows, keys, [c.desc() for c in as_cols(order)])


def delete_matching(target: DataFrame, deletions: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(deletions.select(*keys), keys, "left_anti")


def update_owned(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Apply updates only where id and owner both match; returns the updated rows."""
    renamed = updates.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = target.join(renamed, keys)
    return joined.select(
        *[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns]
    )


def merge_nested(entries: DataFrame, owner: str, keys: list[str], value: str, order) -> DataFrame:
    """Array of (keys, value) per owner: a later entry of a key overwrites it in place,
    new keys are appended in order of first appearance.

    The entries are reduced to one per (owner, key) before the array is built.
    """
    at = F.struct(*as_cols(order))
    merged = entries.groupBy(owner, *keys).agg(F.min(at).alias("__first"), F.max_by(value, at).alias(value))
    item = F.struct(F.col("__first"), *[F.col(k) for k in keys], F.col(value))
    return merged.groupBy(owner).agg(F.sort_array(F.collect_list(item)).alias("__items")).select(
        owner,
        F.transform(
            "__items", lambda s: F.struct(*[s[k].alias(k) for k in keys], s[value].alias(value))
        ).alias("items"),
    )
