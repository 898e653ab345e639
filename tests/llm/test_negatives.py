"""Hard negatives and packed products against plain Python integers."""

import math
import random

import numpy as np
import pytest

from larder.llm import negatives, queries


@pytest.mark.parametrize("top", [0, 1, 100, 2**20, 2**31, 2**40, 2**61])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(0)
    rows, anchors = rng.integers(-top, top + 1, (37, 9)), rng.integers(-top, top + 1, (5, 9))
    packed = negatives.Packed(rows, int(anchors.min()), int(anchors.max()))
    want = [[sum(int(p) * int(q) for p, q in zip(a, r, strict=True)) for r in rows] for a in anchors]
    assert [[int(x) for x in s] for s in packed.scores(anchors)] == want
    if top == 100:
        assert packed.kind is np.uint64 and packed.fields == 3  # three products by one multiplication


def brute(rows):
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        used.append((vec_id, [math.floor(256 * float(np.float64(x))) for x in vector], label))
    out = []
    late = lambda i: (i is None, i or 0)
    for k, (anchor, v, label) in enumerate(used):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), i, g) for m, (i, w, g) in enumerate(used) if m != k and len(w) == len(v)]
        same = sorted([(-s, late(i), i) for s, i, g in scored if g == label])[:5]
        for s, _, positive in same:
            s = -s
            band = sorted([(-n, late(i), i) for n, i, g in scored if g != label and 30 * s <= 100 * n <= 90 * s])[:10]
            out += [(anchor, positive, r + 1, i, s, -n) for r, (n, _, i) in enumerate(band)]
    return out


def run(spark, rows, tmp_path):
    made = spark.createDataFrame([(i, v, g, "x", 1, "y") for i, v, g in rows], "vec_id long, embedding array<double>, label int, row string, width long, vector string")
    made.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r) for r in queries.QUERIES["op13_kronecker_negatives"](spark, str(tmp_path)).collect()]


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    """Ties, copies of a vector, repeated ids, unusable rows, other lengths and sizes, and blocks of a few rows."""
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(6)], rng.randrange(4)) for i in range(330)]
    rows += [(i, [0.5, 0.5, 0.25, 0.0, 0.0, 0.1], i % 3) for i in range(400, 460)]  # copies: all ties
    rows += [rows[100], rows[100], rows[0], (200, [0.9] * 6, 2)]
    rows += [(500, None, 1), (501, [1.0, None], 1), (600, [float("nan")] * 6, 1), (700, [0.1] * 6, None), (800, [], 1), (801, [], 1), (802, [], 2)]
    rows += [(900, [1e200, -1e200], 3), (901, [float("inf"), 1.0], 3), (1000, [3.0, 4.0], 3), (1001, [3.0, 5.0], 3), (1002, [1.0, 3.0], 4), (1003, [2.0, 3.0], 4)]
    rows += [(None, [0.5, 0.5, 0.25, 0.0, 0.0, 0.1], 1), (None, [0.4] * 6, 2), (-100, [0.3] * 6, 1), (1100, [0.0] * 6, 2)]
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "CANDIDATES", 40)
    got, want = run(spark, rows, tmp_path), brute(rows)
    limit = 2**63 - 1
    near = lambda r: (*r[:4], *(min(max(x, -limit - 1), limit) for x in r[4:]))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(map(near, want), key=order)


def test_numbers_beyond_words(spark, tmp_path):
    """Components near 2 ** 34: sums beyond 64-bit fields, results inside 64 bits."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(2**20), 2**20)), float(rng.randrange(2**19))], rng.randrange(2)) for i in range(220)]
    assert sorted(run(spark, rows, tmp_path)) == sorted(brute(rows))


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 2.0], 1)], [(None, None, None)]])
def test_too_few_rows(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == []


def test_given_table_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in queries.QUERIES["op13_kronecker_negatives"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(rows)) and len(got) > 0
