"""A group's surroundings are held once, and the pipeline needs one Python worker a task to cut passages."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from larder.llm import suffixes


def _group(size):
    letters = np.random.default_rng(3).integers(97, 123, size).astype(np.uint8).tobytes().decode()
    return pa.table({"id": pa.array(range(size // 1000), pa.int64()), "text": [letters[k : k + 1000] for k in range(0, size, 1000)]})


def test_surroundings_of_a_group_are_held_once():
    rows = _group(3_000_000)
    shared = np.unique(suffixes._group_anchors(rows)[2] & suffixes._LOW)
    tracemalloc.start()
    found = suffixes._surroundings(rows, shared)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[2][0]) > 100_000 and peak < 60 << 20


@pytest.mark.parametrize("clash", [False, True])
def test_kinds_of_rows_do_not_depend_on_their_order(monkeypatch, clash):
    if clash:  # every second kind has the hash of its neighbour
        monkeypatch.setattr(suffixes, "_content_hash", lambda block: (block[:, 0] // 2).astype(np.uint64))
    rng, seen = np.random.default_rng(5), []
    rows = np.zeros((500, suffixes._HELD), np.uint8)
    rows[:, 0] = rng.integers(0, 40, 500)
    for _ in range(3):
        rows = rows[rng.permutation(500)]
        first, kind = suffixes._alike(rows)
        assert np.array_equal(rows[first][kind], rows) and len(first) == len(np.unique(rows[:, 0]))
        seen.append(rows[first].tobytes())
    assert seen[0] == seen[1] == seen[2]
    assert [len(x) for x in suffixes._alike(rows[:0])] == [0, 0]


def test_one_python_worker_a_task_cuts_passages(spark):
    rows = [(1, "é" * 60 + " first", "fr", 66), (2, "x" + "é" * 60, "fr", 61), (None, "é" * 60, "fr", 60), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    cut = corpus_pipeline.repeated_passages(spark, docs, "")
    assert "EvalPython" not in cut._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {1: rows[0][1::2], 2: ("x", 1), None: rows[2][1::2], 3: (None, None)}
