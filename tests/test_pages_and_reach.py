"""Row numbers and pages against plain order; many roots in one walk against one walk for each."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import graph, ordering


@pytest.fixture(params=["true", "false"])
def coalescing(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_numbers_have_no_gap(spark, coalescing):
    rng = random.Random(1)
    rows = [(i, 5 if i % 3 == 0 else rng.choice([None, rng.randrange(40)])) for i in range(1000)]  # a third share one value
    frame = spark.createDataFrame(rows, "id int, v int").repartition(6)
    got = ordering.with_row_numbers(frame, [F.col("v").desc_nulls_last(), "id"], first=1).collect()
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.id: r.row_no for r in got} == {i: n + 1 for n, (i, _) in enumerate(order)}


def test_every_page_and_any_page(spark, coalescing):
    rows = [(i, (i * 37) % 101) for i in range(733)]
    pages = ordering.Pages(spark.createDataFrame(rows, "id int, v int").repartition(5), ["v", "id"], 50)
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert {(r.page, r.place): r.id for r in pages.all().collect()} == {(n // 50 + 1, n % 50): i for n, i in enumerate(order)}
    for number in (1, 7, 15, 16):
        assert [r.id for r in pages.page(number).collect()] == order[(number - 1) * 50 : number * 50]
    assert tuple(pages.totals().first()) == (733, 15)
    plan = pages.page(7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(row_no), GreaterThanOrEqual(row_no,300), LessThanOrEqual(row_no,349)]" in plan


def test_pages_of_nothing(spark):
    pages = ordering.Pages(spark.createDataFrame([], "id int"), ["id"], 500)
    assert pages.limit == 100 and pages.all().count() == 0 and tuple(pages.totals().first()) == (0, 0)


def test_many_roots_equal_single_walks(spark):
    """More than 63 roots, a hub that a third of the edges touch, loops, repeated and missing roots."""
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(260)] + [(0, i) for i in range(100)] + [(i, 0) for i in range(20)] + [(5, 5), (7, None), (None, 7)]
    roots = [*range(0, 150, 2), 0, 4, 9_999, None]
    frame = spark.createDataFrame(edges, "src int, dst int").repartition(4)
    got = {(r.root, r.node): r.distance for r in graph.reachable_from_each(frame, spark.createDataFrame([(r,) for r in roots], "root int"), 3).collect()}
    out = {}
    for a, b in edges:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    want = {}
    for root in {r for r in roots if r is not None}:
        level, want[root, root] = {root}, 0
        for step in range(1, 4):
            level = {b for a in level for b in out.get(a, ())} - {n for (r, n) in want if r == root}
            want.update({(root, n): step for n in level})
    assert got == want
    one = graph.reachable(frame, spark.createDataFrame([(2,)], "node int"), 3).collect()
    assert {r.node: r.distance for r in one if r.node is not None} == {n: k for (r, n), k in want.items() if r == 2}


def test_no_roots(spark):
    frame = spark.createDataFrame([(1, 2)], "src int, dst int")
    assert graph.reachable_from_each(frame, spark.createDataFrame([], "root int"), 2).count() == 0
