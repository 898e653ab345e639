"""Anchored admission windows over a whole table of hits.

A window of a key opens at its first hit after the previous window has run out, and
admits the first ``limit`` hits. Which hits open a window is a chain: from one
anchor to the first hit more than a window later. Keys of at most ``LIGHT`` hits are
sorted and walked hit by hit. The chain of a heavier key is walked by pointer doubling,
so neither a key with most of the hits nor a long history is ever gathered in one task:
all these steps are keyed by (key, time bucket).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.scaling import top_k
from larder.session import cut_lineage


#: Most hits of a key that are walked in one task.
LIGHT = 100_000
SLICES = 16  # time slices per window: the unit one task sorts when it looks for the next hit


def later_minimum(rows: DataFrame, keys: list[str], place: str, value: str, name: str) -> DataFrame:
    """(keys, place, name): least ``value`` at any later place of the key; one row for each (keys, place).

    Suffix minima in two levels. The rows are sorted globally, so a hot key lies in many range partitions, each of which
    is one task; what a (key, partition) hands back to the earlier partitions of that key is one row of a carry table,
    at most as many for a key as there are partitions.
    """
    placed = rows.select(*keys, place, value).orderBy(*keys, place)
    numbered = cut_lineage(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    inside = Window.partitionBy(*keys, "part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    near = numbered.select(*keys, place, "part", F.min(value).over(inside).alias("near"))
    parts = numbered.groupBy(*keys, "part").agg(F.min(value).alias("least"))
    after = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*keys, "part", F.min("least").over(after).alias("carry"))
    return near.join(carry, [*keys, "part"]).select(*keys, place, F.least("near", "carry").alias(name))


def _next_hits(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, next): first hit more than a window after ``t``; rows without one drop out."""
    slice_of = lambda t: F.floor(t * SLICES / F.col("window")).alias("bucket")
    bucket = slice_of(F.col("t"))
    hits = points.select(*keys, "window", "t", F.col("t").alias("hit"), F.lit(None).cast("bigint").alias("origin"), bucket)
    probes = points.select(
        *keys, "window", (F.col("t") + F.col("window")).alias("t"), F.lit(None).cast("bigint").alias("hit"),
        F.col("t").alias("origin"), slice_of(F.col("t") + F.col("window")),
    )
    # running minimum from the latest hit backwards: the first hit later than t in this bucket
    later = Window.partitionBy(*keys, "bucket").orderBy(-F.col("t")).rangeBetween(Window.unboundedPreceding, -1)
    near = hits.unionByName(probes).withColumn("near", F.min("hit").over(later)).where("origin IS NOT NULL")
    # bucket level: the first hit of any later bucket, for probes that find none in theirs
    firsts = hits.groupBy(*keys, "bucket").agg(F.min("hit").alias("first"))
    asked = near.where("near IS NULL").select(*keys, "bucket").distinct().withColumn("first", F.lit(None).cast("bigint"))
    by_bucket = firsts.unionByName(asked).groupBy(*keys, "bucket").agg(F.min("first").alias("first"))
    found = near.join(later_minimum(by_bucket, keys, "bucket", "first", "far"), [*keys, "bucket"], "left")
    return found.select(*keys, F.col("origin").alias("t"), F.coalesce("near", "far").alias("next")).where("next IS NOT NULL")


def anchors(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t) of the hits that open a window; ``points`` has distinct (keys, t) and window."""
    jump = cut_lineage(_next_hits(points, keys))
    reached = points.groupBy(*keys).agg(F.min("t").alias("t"))
    while jump.limit(1).count():
        step = reached.join(jump, [*keys, "t"]).select(*keys, F.col("next").alias("t"))
        reached = cut_lineage(reached.unionByName(step))  # now twice as far along every chain
        ahead = jump.select(*keys, F.col("t").alias("next"), F.col("next").alias("after"))
        jump = cut_lineage(jump.join(ahead, [*keys, "next"]).select(*keys, "t", F.col("after").alias("next")))
    return reached


def busy_keys(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than ``limit`` hits in two neighbouring buckets, and their number of hits ``n``.

    A window spans at most two buckets, so all hits of the other keys are admitted
    and their chains need not be walked.
    """
    n = hits.groupBy(*keys, "limit", F.floor(F.col("t") / F.col("window")).alias("bucket")).count()
    following = n.select(*keys, (F.col("bucket") - 1).alias("bucket"), F.col("count").alias("more"))
    pair = n.join(following, [*keys, "bucket"], "left")
    over = F.col("count") + F.coalesce("more", F.lit(0)) > F.col("limit")
    return pair.groupBy(*keys).agg(F.max(over).alias("busy"), F.sum("count").alias("n")).where("busy").drop("busy")


def walked(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id) of the admitted hits, each key walked in order of t and event_id; hits without t are a window of their own."""
    rows = hits.select(*keys, "event_id", "t", "window", "limit").repartition(*keys).sortWithinPartitions(*keys, "t", "event_id")
    own = range(len(keys))

    def run(batches):
        key = reset = None
        count = 0
        for batch in batches:
            let_in = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for here, t, window, limit in zip(zip(*(columns[i] for i in own)), *columns[len(keys) + 1 :]):
                if here != key or (t is not None and (reset is None or t > reset)):
                    key, count, reset = here, 0, None if t is None else t + window
                count += 1
                let_in.append(count <= limit)
            yield batch.select(range(len(keys) + 1)).filter(pa.array(let_in, pa.bool_()))

    return rows.mapInArrow(run, rows.select(*keys, "event_id").schema)


def _doubled(contested: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id) of the admitted hits, chains walked by pointer doubling."""
    points = cut_lineage(contested.select(*keys, "window", "t").distinct())
    opened = anchors(points, keys).withColumnRenamed("t", "anchor")
    width = points.select(*keys, "window").distinct()
    # anchors of a key are more than a window apart, so a bucket holds at most one
    at = cut_lineage(
        opened.join(width, keys).select(*keys, F.floor(F.col("anchor") / F.col("window")).alias("bucket"), "anchor")
    )
    placed = contested.withColumn("bucket", F.floor(F.col("t") / F.col("window")))
    same = at.withColumnRenamed("anchor", "same")
    before = at.select(*keys, (F.col("bucket") + 1).alias("bucket"), F.col("anchor").alias("before"))
    both = placed.join(same, [*keys, "bucket"], "left").join(before, [*keys, "bucket"], "left")
    anchor = F.when(F.col("same") <= F.col("t"), F.col("same")).otherwise(F.col("before"))
    most = contested.agg(F.max("limit")).first()[0] or 0  # one number: no window admits more
    first = top_k(both.withColumn("anchor", anchor), [*keys, "anchor"], ["t", "event_id"], most, rank="place")
    return first.where("place <= limit").select(*keys, "event_id")


def admit(hits: DataFrame, keys: list[str], light: int = LIGHT) -> DataFrame:
    """Adds ``admitted`` to hits with columns keys, event_id, t, window (microseconds), limit."""
    busy = cut_lineage(busy_keys(hits, keys))
    let_in = walked(hits.join(busy.where(F.col("n") <= light), keys, "left_semi"), keys)
    heavy = busy.where(F.col("n") > light)
    if not heavy.isEmpty():
        let_in = let_in.unionByName(_doubled(hits.join(heavy, keys, "left_semi"), keys))
    let_in = let_in.withColumn("in_window", F.lit(True))
    calm = busy.select(*keys, F.lit(True).alias("contested"))
    out = hits.join(calm, keys, "left").join(let_in, [*keys, "event_id"], "left")
    admitted = F.col("contested").isNull() | F.col("in_window").isNotNull()
    return out.select(*[hits[c] for c in hits.columns if c not in (*keys, "event_id")], *keys, "event_id", admitted.alias("admitted"))
