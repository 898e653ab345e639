"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once more: that speaker's turns as
``assistant``, everybody else's as ``user`` with the speaker's name, system turns as ``system``. A row is one turn of
one such view, with its text in the template, its place in the rendered dialogue and the loss mask (characters of the
assistant's own words and the end mark; headers and all other turns are masked out). Rows keep long dialogues whole
without gathering them: ``render`` of any range is the concatenation of ``segment`` in order of ``position``.

Places are running sums in three steps, so a conversation with a third of all rows is many tasks: the turns are sorted
globally (range partitions), summed inside each (partition, dialogue) and completed by the totals of the earlier
partitions of that dialogue, a table of one row for each partition and dialogue.

Defined cases: turns are ordered by turn, role, text, nulls first; repeated rows are rendered each. A null text is
empty. A null role is the name ``unknown`` and a participant. A null conversation id is one conversation. A
conversation with system turns only has no participant and no view. An empty table gives no row; other columns are
ignored. Blanks and line ends in a name become ``_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import plain
from larder.session import cut_lineage

OPEN, CLOSE, LINE = "<|im_start|>", "<|im_end|>", "\n"
SYSTEM = "system"
UNKNOWN = "unknown"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, position, turn, role, name, segment, start, length, mask_start, mask_length)."""
    named = plain(turns, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "said_by", "said")
    named = named.select("conv_id", "turn", "said_by", "said", F.coalesce("said_by", F.lit(UNKNOWN)).alias("speaker"))
    cast = named.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    views = named.join(cast, named.conv_id.eqNullSafe(cast.c)).drop("c")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(own, "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(~own & ~system, F.regexp_replace("speaker", "\\s", "_"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit(LINE))
    body = F.concat(F.coalesce("said", F.lit("")), F.lit(CLOSE))
    parts = views.select("conv_id", "perspective", "turn", "said_by", "said", role.alias("role"), name.alias("name"), head.alias("head"), body.alias("body"), own.alias("own"))
    sized = parts.withColumn("segment", F.concat("head", "body", F.lit(LINE))).withColumn("length", F.length("segment").cast("long"))

    # global order; frozen, so that both readers below see the same partition numbers
    ordered = sized.orderBy(F.col("conv_id"), "perspective", F.col("turn").asc_nulls_first(), F.col("said_by").asc_nulls_first(), F.col("said").asc_nulls_first(), F.rand(7))
    numbered = cut_lineage(ordered.drop("said", "said_by").withColumn("at", F.monotonically_increasing_id()))
    block = F.shiftright("at", 33)
    blocks = numbered.groupBy("conv_id", "perspective", block.alias("block")).agg(F.count("*").alias("turns"), F.sum("length").alias("chars"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"),
    )
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("at")
    local = numbered.withColumn("block", block).withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = local.join(carried, local.conv_id.eqNullSafe(carried.c) & (local.perspective == carried.p) & (local.block == carried.b))
    start = F.col("chars_before") + F.col("upto") - F.col("length")
    return joined.select(
        "conv_id", "perspective", (F.col("turns_before") + F.col("nth") - 1).alias("position"), "turn", "role", "name", "segment", start.alias("start"), "length",
        F.when(F.col("own"), start + F.length("head")).alias("mask_start"), F.when(F.col("own"), F.length("body").cast("long")).otherwise(0).alias("mask_length"),
    )


ROTATE_SQL = rf"""
WITH named AS (SELECT conv_id, turn, role, text, coalesce(role, '{UNKNOWN}') AS speaker FROM conversations),
members AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM named WHERE speaker <> '{SYSTEM}'),
views AS (
    SELECT n.*, m.perspective, speaker = perspective AS own, speaker = '{SYSTEM}' AS sys,
           row_number() OVER (PARTITION BY n.conv_id, m.perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position
    FROM named n JOIN members m ON n.conv_id IS NOT DISTINCT FROM m.c),
parts AS (
    SELECT *, CASE WHEN own THEN 'assistant' WHEN sys THEN '{SYSTEM}' ELSE 'user' END AS shown,
           CASE WHEN NOT own AND NOT sys THEN regexp_replace(speaker, '\s', '_', 'g') END AS name,
           coalesce(text, '') || '{CLOSE}' AS body FROM views),
heads AS (SELECT *, '{OPEN}' || shown || coalesce(' name=' || name, '') || chr(10) AS head FROM parts),
sized AS (SELECT *, head || body || chr(10) AS segment, CAST(length(head || body || chr(10)) AS BIGINT) AS length FROM heads),
placed AS (
    SELECT *, CAST(sum(length) OVER (PARTITION BY conv_id, perspective ORDER BY position) - length AS BIGINT) AS start FROM sized)
SELECT conv_id, perspective, position, turn, shown AS role, name, segment, start, length,
       CASE WHEN own THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN own THEN CAST(length(body) AS BIGINT) ELSE 0 END AS mask_length
FROM placed
"""
