"""Hard negatives by Kronecker-packed products.

Vectors become integers, ``floor(256 * x)``. Several candidates' components of one dimension, made non-negative by a
bias, lie in separated fields of one wide integer; one multiplication by the anchor's component and one addition serve
all of them. The fields are as wide as the largest sum that the block's own values can reach, so no field runs into the
next and unpacking gives exact scores: as many fields as fit into 64 bits, or, for wider sums, Python's integers of any
width with ``FIELDS`` fields. Anchors are biased as well, and both biases are taken off with the sums of components.

Anchors are every row whose id is divisible by 100, against all rows. Rows are dealt to blocks by a frozen row number:
a cell is a block of anchors against a block of candidates, so a label or an id with most of the rows is many cells.
First each anchor's best rows of its own label are found in cells of that label, then, in cells of all rows, the
best rows of other labels within each positive's band of scores. A cell returns at most as many rows as are asked for,
and what the cells found is merged by ``row_number() <= k``.

Defined cases: rows with a null label or vector, or with a null or non-finite component (also once scaled), take no
part; vectors of different length do not meet; an anchor without positives has no rows; repeated rows are rows; a null
id is no anchor and comes last among ties; scores beyond 64 bits are exact inside a cell, but returned and merged as
the nearest 64-bit number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import plain
from larder.session import cut_lineage

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: Score band of a negative, in hundredths of the positive's score.
LEAST, MOST = 30, 90
#: Rows of one cell's sides.
ANCHORS, CANDIDATES = 512, 4096
#: Fields of one Python integer when the sums are too wide for 64 bits.
FIELDS = 32
LONG = np.iinfo(np.int64)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(row, id, label, width, vector) of the rows that take part; the vector as little-endian bytes or decimal text."""

    def each(batches):
        for batch in batches:
            keep, blobs, widths = [], [], []
            column = batch.column(3)
            for i in range(batch.num_rows):
                own = column[i].values if column[i].is_valid else None
                if own is None or own.null_count:
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(own.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
                if not np.isfinite(v).all():
                    continue
                small = not len(v) or np.abs(v).max() < 2**62
                blobs.append(v.astype("<i8").tobytes() if small else b"x" + b",".join(str(int(x)).encode() for x in v))
                widths.append(len(v))
                keep.append(i)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(widths, pa.int32()), pa.array(blobs, pa.binary())], names=["row", "id", "label", "width", "vector"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(each, f"row long, id long, label {label}, width int, vector binary")


def _numbers(blobs: list[bytes], width: int) -> np.ndarray:
    """Integer matrix of some vectors; Python integers if any of them needs it."""
    if any(len(b) != 8 * width or b[:1] == b"x" and b.count(b",") == width - 1 for b in blobs):
        rows = [[int(x) for x in b[1:].split(b",")] if len(b) != 8 * width or b[:1] == b"x" and b.count(b",") == width - 1 else np.frombuffer(b, "<i8").tolist() for b in blobs]
        return np.array(rows, object).reshape(len(blobs), width)
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), width)


class Packed:
    """Candidates of one length, packed for products with anchors whose components span ``low`` to ``high``."""

    def __init__(self, candidates: np.ndarray, low: int, high: int):
        n, width = candidates.shape
        ints = [[int(x) for x in side] for side in (candidates.min(0), candidates.max(0))] if n and width else [[0] * width] * 2
        self.n, self.low, self.bias = n, low, ints[0]
        reach = sum(top - bottom for bottom, top in zip(*ints, strict=True)) * (high - low)
        self.bits = max(1, reach.bit_length())
        self.fields = 64 // self.bits or FIELDS
        self.kind = np.uint64 if self.bits <= 64 and candidates.dtype != object else object
        if self.kind is object and self.bits <= 64:
            self.fields = FIELDS
        lanes = -(-n // self.fields)
        raised = np.zeros((lanes * self.fields, width), self.kind)
        raised[:n] = (candidates - np.array(ints[0], candidates.dtype)).astype(self.kind)
        self.sums = raised[:n].sum(1) if width else np.zeros(n, self.kind)
        raised = raised.reshape(self.fields, lanes, width)
        self.words = np.zeros((lanes, width), self.kind)
        for field in range(self.fields):
            self.words += raised[field] << self._number(field * self.bits)

    def _number(self, x: int):
        return np.uint64(x) if self.kind is np.uint64 else x

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products of some anchors with all candidates, one row for each anchor."""
        raised = (anchors - self.low).astype(self.kind)
        total = raised @ self.words.T  # each component is multiplied once with a word and so with all its fields
        mask = self._number((1 << self.bits) - 1)
        fields = np.concatenate([(total >> self._number(k * self.bits)) & mask for k in range(self.fields)], 1)[:, : self.n]
        exact = anchors.astype(object)
        offset = exact @ np.array(self.bias, object) if len(self.bias) else np.zeros(len(anchors), object)
        most = max((abs(int(x)) for x in offset), default=0) + (abs(self.low) + 1) * (1 << self.bits)
        kind = object if self.kind is object or most >= 2**62 else np.int64
        return fields.astype(kind) + self.low * self.sums.astype(kind) + offset.astype(kind)[:, None]


def _long(scores) -> np.ndarray:
    """As 64-bit numbers, the nearest where they are beyond."""
    return np.array([min(max(int(x), LONG.min), LONG.max) for x in scores], np.int64) if scores.dtype == object else scores


def _sides(anchors: pa.Table, rows: pa.Table):
    """Integer matrices of both sides, candidates in order of id (nulls last), and the candidates' words."""
    rows = rows.take(pa.array(np.lexsort((rows["id"].fill_null(0).to_numpy(), rows["id"].is_null().to_numpy(zero_copy_only=False)))))
    width = rows["width"][0].as_py()
    a, c = _numbers(anchors["vector"].to_pylist(), width), _numbers(rows["vector"].to_pylist(), width)
    if object in (a.dtype, c.dtype):
        a, c = a.astype(object), c.astype(object)
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    return a, rows, Packed(c, low, high)


def _falling(scores: np.ndarray) -> np.ndarray:
    """Places in order of falling score, earlier places first among equals."""
    bits = len(scores).bit_length()
    if scores.dtype == object or not len(scores) or max(abs(int(scores.min())), abs(int(scores.max()))) >= 1 << (62 - bits):
        return np.argsort(-scores, kind="stable")
    return np.sort((-scores << bits) | np.arange(len(scores))) & ((1 << bits) - 1)  # score and place in one number


def _tiles(anchors: pa.Table, vectors: np.ndarray, packed: Packed):
    """(row of the anchor table, scores) of all anchors, some at a time."""
    for lo in range(0, len(vectors), 64):
        for k, scores in enumerate(packed.scores(vectors[lo : lo + 64])):
            yield lo + k, scores


def _positives(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Best rows of the anchors' own label in one cell."""
    out = {"anchor": [], "positive_id": [], "positive_score": []}
    if anchors.num_rows and rows.num_rows:
        vectors, rows, packed = _sides(anchors, rows)
        ids, numbers, own = rows["id"].to_pylist(), rows["row"].to_numpy(), anchors["row"].to_pylist()
        for k, scores in _tiles(anchors, vectors, packed):
            best = [i for i in _falling(scores)[: POSITIVES + 1] if numbers[i] != own[k]][:POSITIVES]
            out["anchor"] += [own[k]] * len(best)
            out["positive_id"] += [ids[i] for i in best]
            out["positive_score"] += _long(scores[best]).tolist()
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _within_band(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Best rows of other labels within each positive's band in one cell."""
    out = {"anchor": [], "place": [], "negative_id": [], "negative_score": []}
    if anchors.num_rows and rows.num_rows:
        vectors, rows, packed = _sides(anchors, rows)
        labels = rows["label"].combine_chunks().dictionary_encode()
        labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
        code, codes = labels.indices.to_numpy(), {name: k for k, name in enumerate(labels.dictionary.to_pylist())}
        others = {k: np.flatnonzero(code != k) for k in [*codes.values(), -1]}
        ids, own = rows["id"].to_pylist(), anchors["row"].to_pylist()
        names, positives = anchors["label"].to_pylist(), anchors["positives"].to_pylist()
        for k, scores in _tiles(anchors, vectors, packed):
            other = others[codes.get(names[k], -1)]
            order = other[_falling(scores[other])]
            rising = -scores[order]
            for place, score in enumerate(positives[k]):
                high, low = (MOST * score) // 100, -((-LEAST * score) // 100)
                if low > high:
                    continue
                begin, end = np.searchsorted(rising, -high, "left"), np.searchsorted(rising, -low, "right")
                found = order[begin : min(end, begin + NEGATIVES)]
                out["anchor"] += [own[k]] * len(found)
                out["place"] += [place] * len(found)
                out["negative_id"] += [ids[i] for i in found]
                out["negative_score"] += _long(scores[found]).tolist()
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _cells(anchors: DataFrame, rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` for every block of anchors against every block of rows with equal ``keys``."""
    many = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = many(anchors, ANCHORS, "anchor_blocks").join(many(rows, CANDIDATES, "row_blocks"), keys)
    block = lambda name: F.expr(f"cast(pmod(xxhash64(row), {name}) as int)")
    spread = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = anchors.join(sizes, keys).withColumn("anchor_block", block("anchor_blocks")).withColumn("row_block", spread("row_blocks"))
    right = rows.join(sizes, keys).withColumn("row_block", block("row_blocks")).withColumn("anchor_block", spread("anchor_blocks"))
    cell = [*keys, "anchor_block", "row_block"]
    tidy = lambda df, own: df.select(*(F.col(c).alias(c) for c in [*cell, *(c for c in own if c not in cell)]))
    return tidy(left, anchors.columns).groupBy(*cell).cogroup(tidy(right, rows.columns).groupBy(*cell)).applyInArrow(fn, schema)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    given = plain(vectors, id_col, label_col, vector_col).toDF("id", "label", "vector").where("label is not null and vector is not null")
    numbered = given.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.col("vector").cast("array<double>"))
    rows = cut_lineage(whole_vectors(numbered))
    anchors = rows.where(F.col("id") % every == 0)

    found = cut_lineage(_cells(anchors, rows, ["label", "width"], _positives, "anchor long, positive_id long, positive_score long"))
    best = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last())
    positives = cut_lineage(found.withColumn("place", F.row_number().over(best) - 1).where(f"place < {POSITIVES}"))

    listed = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p")).select("anchor", F.expr("transform(p, x -> x.positive_score)").alias("positives"))
    asking = cut_lineage(anchors.join(listed, anchors["row"] == listed["anchor"]).select("row", "id", "label", "width", "vector", "positives"))
    near = _cells(asking, rows, ["width"], _within_band, "anchor long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(order)).where(f"rank <= {NEGATIVES}")
    named = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    told = positives.select("anchor", F.col("place").cast("long"), "positive_id", "positive_score")
    return ranked.join(told, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
