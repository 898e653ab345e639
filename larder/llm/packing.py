"""Sum-of-squares online packing of token documents into windows.

``level[f]`` counts the open windows that are filled to ``f``. A document's full windows are cut off first; what is
left goes to the fill level (or to a new window) for which the sum of squared counts of partially filled windows is
least afterwards, ties to the fullest. Every ``GROUP`` tokens, and at a task's end, the open windows are closed: the
emptiest are cut up to fill the fullest, so at most one window of a group stays short.

One pass without a shuffle: a task packs the rows it reads, so any number of tasks works alike, and a lost task is
repeated with the same result. Sequence ids are unique; the high bits name the task.

Defined cases: null or empty text is the end id alone; a null id is kept as null; repeated rows are packed each; an
empty table gives no piece; other columns are ignored. A task holds the ids of one group and of its longest document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larder.llm.common import give_back, plain
from larder.llm.encoding import Encoder

WINDOW = 2048
GROUP = 1 << 22
END = 1
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places lengths into windows of ``size``; a window is a list of (document, start, length)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.full: list[list] = []

    def add(self, doc: int, length: int) -> None:
        whole = length - length % self.size
        self.full += [[(doc, start, self.size)] for start in range(0, whole, self.size)]
        rest = length - whole
        if rest:
            level, top = self.level, self.size - rest
            change = 2 * level[rest : self.size + 1] + 1  # one more window at the level reached
            change[top] = 0  # a full window is no longer partially filled
            change[1:] += 1 - 2 * level[1 : top + 1]  # one fewer at the level left
            usable = level[: top + 1] > 0
            usable[0] = True
            change[~usable] = np.iinfo(np.int64).max
            fill = top - int(np.argmin(change[::-1]))
            window = []
            if fill:
                level[fill] -= 1
                window = self.open[fill].pop()
            window.append((doc, whole, rest))
            if fill == top:
                self.full.append(window)
            else:
                level[fill + rest] += 1
                self.open[fill + rest].append(window)

    def close(self) -> list[list]:
        """All windows; the emptiest open ones are cut to fill the fullest."""
        left = [[f, w] for f in range(self.size, 0, -1) for w in self.open[f]]
        lo, hi = 0, len(left) - 1
        while lo < hi:
            fill, window = left[lo]
            doc, start, length = left[hi][1].pop()
            part = min(length, self.size - fill)
            window.append((doc, start, part))
            left[lo][0] += part
            left[hi][0] -= part
            if part < length:
                left[hi][1].append((doc, start + part, length - part))
            lo += left[lo][0] == self.size
            hi -= not left[hi][1]
        done = self.full + [w for _, w in left if w]
        self.__init__(self.size)
        return done


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP, end_id: int = END) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = plain(docs, id_col, text_col)

    def each(batches):
        give_back()
        encoder, packer = Encoder(tokenizer), Packer(window)
        end = np.array([end_id], encoder.kind)
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal number, tokens
            out = [[] for _ in range(7)]
            for w in packer.close():
                offset = 0
                for doc, start, length in w:
                    name, ids = held[doc]
                    crc = zlib.crc32(ids[start : start + length].astype("<u4"))
                    for column, value in zip(out, (name, start, length, crc, len(ids), (task << 40) + number, offset), strict=True):
                        column.append(value)
                    offset += length
                number += 1
            held.clear()
            tokens = 0
            for lo in range(0, len(out[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 10_000], pa.int64()) for c in out], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), encoder.rows(batch.column(1)), strict=True):
                ids = np.concatenate([own, end])
                packer.add(len(held), len(ids))
                held.append((name, ids))
                tokens += len(ids)
                if tokens >= group:
                    yield from flush()
        yield from flush()
        del encoder, packer
        give_back()

    return rows.mapInArrow(each, SCHEMA)
