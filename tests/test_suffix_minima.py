"""Two-level suffix minima: right for any spread of keys, and a hot key lies in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import windows


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute(rows):
    by_key = {}
    for key, place, value in rows:
        by_key.setdefault(key, []).append((place, value))
    return {(k, p): min((v for q, v in own if q > p and v is not None), default=None) for k, own in by_key.items() for p, _ in own}


def test_equal_to_plain_minima_with_a_hot_key_over_many_tasks(spark, many_partitions):
    rng = random.Random(2)
    rows = [("hot", i, rng.choice([None, rng.randrange(10**6)])) for i in range(4000)]
    rows += [(f"k{i % 300}", i, rng.choice([None, i])) for i in range(2000)] + [("last", 5, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "user string, bucket long, first long").repartition(5)
    found = windows.later_minimum(frame, ["user"], "bucket", "first", "far")
    assert {(r.user, r.bucket): r.far for r in found.collect()} == brute(rows)
    # the tasks that sort the hot key: several, none with all of its rows
    spread = frame.orderBy("user", "bucket").groupBy("user", F.spark_partition_id().alias("part")).count().where("user = 'hot'").collect()
    assert len(spread) > 2 and max(r["count"] for r in spread) < 2500


def test_admission_of_a_hot_key_over_many_tasks(spark, many_partitions):
    rng = random.Random(4)
    width, limit, t, rows = 1000, 3, 0, []
    for i in range(1500):  # long gaps, so that the next hit is often many buckets away
        t += rng.choice([1, 5, 40, 900, 30_000])
        rows.append((7, i, t, width, limit))
    rows += [(k, 10_000 + k * 10 + j, j * 50, width, limit) for k in range(20, 40) for j in range(6)]
    frame = spark.createDataFrame(rows, "user_id long, event_id long, t long, window long, limit long").repartition(4)
    want = {}
    for key in {r[0] for r in rows}:
        opened, n = None, 0
        for _, event, at, _, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if opened is None or at > opened + width:
                opened, n = at, 0
            n += 1
            want[event] = n <= limit
    assert {r.event_id: r.admitted for r in windows.admit(frame, ["user_id"]).collect()} == want
