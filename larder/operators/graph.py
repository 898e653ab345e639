"""Bounded reachability over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.ordering import with_row_numbers
from larder.session import cut_lineage


def reachable(edges: DataFrame, roots: DataFrame, depth: int, expand: Column | None = None) -> DataFrame:
    """(node, distance) of nodes within ``depth`` steps of the roots.

    ``edges`` has src and dst, ``roots`` has node. Only nodes that satisfy
    ``expand`` (a predicate on ``node``) are walked on from; the others are still
    reported, so links saved on the last walked level appear one step further out.

    Each level is one join of the frontier with the edges, an anti join with the
    nodes seen, and a reliable checkpoint, so plans stay small and a lost executor
    costs one level.
    """
    level = roots.select("node").distinct().withColumn("distance", F.lit(0))
    seen = level
    for step in range(1, depth + 1):
        front = level.where(expand) if expand is not None else level
        found = (
            edges.join(front.select(F.col("node").alias("src")), "src")
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(seen.select("node"), "node", "left_anti")
            .withColumn("distance", F.lit(step))
        )
        level = cut_lineage(found)
        seen = seen.unionByName(level)
    return seen


#: Roots that one row carries: the bits of a number, less its sign.
ROOTS_A_ROW = 63


def reachable_from_each(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance) of the nodes within ``depth`` steps of each root, all roots in one walk.

    ``edges`` has src and dst, ``roots`` has root. Roots are numbered; a frontier row is (node, group of 63 roots, bits), so
    what 63 walks have in common is carried and joined once. A level is one join with the edges, one ``bit_or`` by
    node and group (combined on the map side, so a hub is no single task) and the removal of bits seen before; it is written,
    so a lost executor costs one level. A node that is its own root is at distance 0; nulls reach nothing.
    """
    numbered = with_row_numbers(roots.select("root").where("root IS NOT NULL").distinct(), ["root"], "number")
    placed = cut_lineage(numbered.select("root", F.floor(F.col("number") / ROOTS_A_ROW).alias("group"), (F.col("number") % ROOTS_A_ROW).cast("int").alias("bit")))
    shifted = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    level = cut_lineage(placed.select(F.col("root").alias("node"), "group", shifted.alias("bits")).groupBy("node", "group").agg(F.bit_or("bits").alias("bits")))
    levels = [level.withColumn("distance", F.lit(0))]
    seen = level
    for step in range(1, depth + 1):
        found = edges.join(level.withColumnRenamed("node", "src"), "src").where("dst IS NOT NULL")
        reached = found.groupBy(F.col("dst").alias("node"), "group").agg(F.bit_or("bits").alias("bits"))
        known = seen.withColumnRenamed("bits", "known")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint"))))
        level = cut_lineage(reached.join(known, ["node", "group"], "left").select("node", "group", fresh.alias("bits")).where("bits <> 0"))
        levels.append(level.withColumn("distance", F.lit(step)))
        seen = seen.unionByName(level).groupBy("node", "group").agg(F.bit_or("bits").alias("bits"))
        if step < depth:
            seen = cut_lineage(seen)
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    each = every.select("node", "group", "distance", "bits", F.explode(F.sequence(F.lit(0), F.lit(ROOTS_A_ROW - 1))).alias("bit"))
    there = each.where(F.expr("shiftright(bits, bit) & 1") == 1)
    return there.join(placed, ["group", "bit"]).select("root", "node", "distance")
