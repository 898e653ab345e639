"""Scoring takes a bounded number of bytes however many texts a batch holds."""

import tracemalloc

import numpy as np

from larder.llm import ppm


def _trees():
    text = np.frombuffer(b"the quick brown fox jumps over the lazy dog " * 20, np.uint8)
    gram, n = np.unique(ppm._grams(text, np.array([0, len(text)])), return_counts=True)
    return ppm.Trees({lang: np.stack([gram.astype(np.int64), n], 1) for lang in ("a", "b", "c", "d")})


def test_scoring_a_megabyte_is_cut_into_pieces():
    trees, rng = _trees(), np.random.default_rng(1)
    data = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    offsets = np.concatenate([np.arange(0, 1 << 20, 1000), [1 << 20]])
    tracemalloc.start()
    got = trees.lengths(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    some = [0, 7, 130, 131, 132, 1048]
    alone = [trees.lengths(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0] for i in some]
    assert np.array_equal(got[some], np.array(alone))


def test_no_rows_and_empty_rows():
    trees = _trees()
    assert trees.lengths(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape == (0, 4)
    assert np.array_equal(trees.lengths(np.zeros(0, np.uint8), np.zeros(4, np.int64)), np.zeros((3, 4)))
