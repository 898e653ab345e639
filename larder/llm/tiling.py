"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``MIN_WORDS`` words (a seed) are tiled: the longest common run of
unmarked words is marked on both sides again and again, until none of ``MIN_WORDS`` is left. Runs are found by running
Karp-Rabin: window hashes of a falling length, restarted at twice the length when a longer match appears. Tiles may
lie in any order, so a passage whose sentences were moved is still covered. The document is contaminated by the item
if tiles cover at least ``COVERAGE`` of the item's words.

Words are runs of ASCII letters, digits and all other characters outside ASCII, in lower case. The benchmark is the stated query set: it is
taken in blocks of about ``BLOCK`` bytes, and each block is sent to one pass over the documents, which needs no
shuffle; all documents are read whole, and nothing about documents reaches the driver.

Defined cases: an item of fewer than ``MIN_WORDS`` words must occur whole as one run; items and documents without words
or text match nothing; rows with a null id are left out of the pairs; repeated rows give repeated pairs; an empty table
on either side gives no pair; other columns are ignored. Memory of a task grows with its longest document.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import MARKS, mix, plain, prefix_hash, range_hash, text_chunks, words

MIN_WORDS = 5
COVERAGE = 0.75
BLOCK = 8 << 20
_BITS = 22


def _matches(a_prefix, b_prefix, a_marked, b_marked, size):
    """Maximal runs (length, start in b, start in a) of at least ``size`` unmarked words, by window hashes."""
    free = []
    for prefix, marked in ((a_prefix, a_marked), (b_prefix, b_marked)):
        starts = np.arange(len(prefix) - size)
        used = np.concatenate([[0], np.cumsum(marked)])
        starts = starts[used[starts + size] == used[starts]]
        free.append((starts, range_hash(prefix, starts, starts + size)))
    (a, ha), (b, hb) = free
    order = np.argsort(hb, kind="stable")
    b, hb = b[order], hb[order]
    lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    times = hi - lo
    i = np.repeat(a, times)
    if not len(i):
        return []
    j = b[np.repeat(lo, times) + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = ((i - j)[1:] != (i - j)[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i))) + size - 1
    return list(zip((-length).tolist(), j[first].tolist(), i[first].tolist(), strict=True))


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length) of two word sequences, longest first; ties by place in b, then in a."""
    a_prefix, b_prefix = prefix_hash(a), prefix_hash(b)
    a_marked, b_marked = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles, size = [], min(len(a), len(b))
    while size >= least:
        found = _matches(a_prefix, b_prefix, a_marked, b_marked, size)
        longest = -min(found)[0] if found else 0
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(found)
        while found:
            length, j, i = heapq.heappop(found)
            taken = a_marked[i : i - length] | b_marked[j : j - length]
            if not taken.any():
                a_marked[i : i - length] = b_marked[j : j - length] = True
                tiles.append((i, j, -length))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for lo, hi in edge.reshape(-1, 2):  # what is left of the run
                if hi - lo >= size:
                    heapq.heappush(found, (int(lo - hi), j + int(lo), i + int(lo)))
        size = size // 2 if size > 2 * least else least if size > least else 0
    return tiles


def _grams(hashed: np.ndarray, row: np.ndarray, width: int):
    """Hash of every run of ``width`` words within a row, and the first word's position."""
    if len(hashed) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
    out = np.zeros(len(hashed) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[j : len(hashed) - width + 1 + j]
    return mix(out[at]), at


class _Items:
    """Words of a block of benchmark items and their runs by width."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int):
        self.ids = [r[0] for r in rows]
        self.words = []
        for _, _, data, offsets in text_chunks(pa.array([r[1] for r in rows], pa.string())):
            hashed, _, at = words(data, offsets, MARKS)
            self.words += [hashed[at[k] : at[k + 1]] for k in range(len(offsets) - 1)]
        self.by_width = {}
        width = np.array([min(least, len(w)) for w in self.words], int)
        for n in set(width.tolist()) - {0}:
            own = np.flatnonzero(width == n)
            flat = np.concatenate([self.words[k] for k in own])
            item = np.repeat(own, [len(self.words[k]) for k in own])
            keys, at = _grams(flat, item, n)
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << _BITS, bool)
            maybe[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by_width[n] = keys[order], item[at[order]], maybe

    def seeds(self, hashed, row):
        """(row, item, number of seeds) of the pairs that share a run."""
        for n, (keys, item, maybe) in self.by_width.items():
            grams, at = _grams(hashed, row, n)
            near = maybe[(grams >> np.uint64(64 - _BITS)).astype(np.int64)]
            grams, at = grams[near], at[near]
            lo, hi = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            times = hi - lo
            rows = np.repeat(row[at], times)
            if len(rows):
                items = item[np.repeat(lo, times) + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)]
                pairs, count = np.unique(np.stack([rows, items]), axis=1, return_counts=True)
                for r, k, c in zip(*pairs.tolist(), count.tolist(), strict=True):
                    yield r, k, n, c


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """(id, item_id, item_words, covered, tiles, longest, coverage) of each contaminated pair."""
    spark = docs.sparkSession
    docs = plain(docs, id_col, text_col).toDF("id", "text").where("id is not null and text is not null").select("id", F.lower("text").alias("text"))
    items = plain(benchmark, item_col, item_text).toDF("item_id", "text").where("item_id is not null and text is not null").select("item_id", F.lower("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    schema = "id long, item_id long, item_words int, covered int, tiles int, longest int, coverage double"

    def passed(block: int) -> DataFrame:
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        sent = spark.sparkContext.broadcast(rows)

        def each(batches):
            index = _Items(sent.value, min_words)
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for lo, _, data, offsets in text_chunks(batch.column(1)):
                    hashed, row, at = words(data, offsets, MARKS)
                    for r, k, n, seeds in index.seeds(hashed, row):
                        item = index.words[k]
                        if seeds * n < coverage * len(item):
                            continue  # a tile of t words has t - n + 1 seeds, so tiles cover at most n words a seed
                        tiles = tile(hashed[at[r] : at[r + 1]], item, n)
                        got = sum(t[2] for t in tiles)
                        if got >= coverage * len(item):
                            found.append((ids[lo + r], index.ids[k], len(item), got, len(tiles), max(t[2] for t in tiles), got / len(item)))
                columns = list(zip(*found, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "item_id", "item_words", "covered", "tiles", "longest", "coverage"])

        return docs.mapInArrow(each, schema)

    if not blocks:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, [passed(k) for k in range(blocks)])
