"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are a bounded sample: the ``PIVOTS_PER_ROOT`` x sqrt(n) vectors with the smallest hash, at
least ``LEAST_PIVOTS`` and at most ``MOST_PIVOTS``, less those close to an earlier one. Every vector is described by
its ``NEAREST`` nearest pivots in order and posted to the inverted lists of those it needs: two vectors that share at
least ``SHARED`` of their pivots share one among each one's ``NEAREST - SHARED + 1`` rarest. Inside a list the shared
pivots of two vectors are counted; pairs with enough are verified by cosine in double precision. A pair counts only in
the first list that both are posted to, so links are summed without ever writing pairs: a task returns, per vector,
its number of links, and links that hold its connected vectors together. Lists longer than ``BLOCK`` are cut by hash
and every two cuts meet in a task of their own.

Equal vectors of one label are one class, posted once with their number. Recall of the retrieval is measured in
tests and the README; no pair below the threshold is ever linked.

Defined cases: null, zero or non-finite vectors, vectors with null components and null labels link with nothing and
are returned with 0 links; vectors of another length than the usual never compare with it; rows with one id count each
but share a component; null ids are left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, plain
from larder.session import cut_lineage

COSINE = 0.98
NEAREST = 8
SHARED = 4
PIVOTS_PER_ROOT = 4.0
LEAST_PIVOTS = 64
MOST_PIVOTS = 4096
#: Rows of a list that meet another such block in one task.
BLOCK = 4096


def _classes(vectors: DataFrame) -> DataFrame:
    """(id, class key, bytes of the vector) of the usable rows; the key covers label and exact values."""

    def each(batches):
        for batch in batches:
            ids, keys, blobs, labels = [], [], [], []
            column = batch.column(2)
            for i, (name, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if not column[i].is_valid:
                    continue
                own = column[i].values
                if own.null_count or not len(own):
                    continue
                v = own.to_numpy().astype(np.float64) + 0.0
                if not np.isfinite(v).all() or not v.any():
                    continue
                ids.append(name)
                labels.append(label)
                blobs.append(v.tobytes())
                keys.append(hashlib.blake2b(f"{label}|".encode() + blobs[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["id", "label", "key", "vector"])

    return vectors.mapInArrow(each, "id long, label long, key binary, vector binary")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _choose(reps: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivots by dimension: a bounded sample in order of a hash of the id."""
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PIVOTS_PER_ROOT * count**0.5)))
    rows = reps.select("vector").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    by_width: dict[int, list] = {}
    for (blob,) in rows:
        v = _unit(np.frombuffer(blob, np.float64))
        near = by_width.setdefault(len(v), [])
        if not near or float(np.max(np.array(near) @ v)) < 0.9:
            near.append(v)
    return {k: np.array(v) for k, v in by_width.items()}


def _describe(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, label, n, vector, width, pivots in order of nearness)."""
    sent = reps.sparkSession.sparkContext.broadcast(pivots)

    def each(batches):
        for batch in batches:
            vectors = [np.frombuffer(b, np.float64) for b in batch.column(3).to_pylist()]
            width, near = np.array([len(v) for v in vectors], np.int32), [[]] * len(vectors)
            for w in set(width.tolist()):
                rows = np.flatnonzero(width == w)
                points = sent.value.get(w)
                if points is None:  # no vector of this length was sampled: one list for all of them
                    points = np.ones((1, w))
                for lo in range(0, len(rows), 2048):
                    some = rows[lo : lo + 2048]
                    order = np.argsort(-(_unit(np.array([vectors[i] for i in some])) @ points.T), axis=1, kind="stable")[:, :NEAREST]
                    for i, o in zip(some, order.tolist(), strict=True):
                        near[i] = o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width), pa.array(near, pa.list_(pa.int32()))], names=["id", "label", "n", "vector", "width", "near"])

    return reps.mapInArrow(each, "id long, label long, n long, vector binary, width int, near array<int>")


def _meet(key, tbl):
    """Links found in one list: per vector its number, and edges that keep linked vectors together."""
    pivot, left, right = key[2].as_py(), key[3].as_py(), key[4].as_py()
    tbl = tbl.sort_by("id")
    ids, n, part = tbl["id"].to_numpy(), tbl["n"].to_numpy(), tbl["part"].to_numpy()
    v = np.frombuffer(b"".join(tbl["vector"].to_pylist()), np.float64).reshape(len(ids), -1)
    norm = np.sqrt((v * v).sum(1))
    near = [np.array(x) for x in tbl["near"].to_pylist()]
    posted = [x for x in tbl["posted"].to_pylist()]
    wide = int(max(max(map(max, near)), max(map(max, posted)))) + 1
    has, rank = np.zeros((len(ids), wide), np.float32), np.full((len(ids), wide), False)
    for i, (a, p) in enumerate(zip(near, posted, strict=True)):
        has[i, a] = 1
        rank[i, p] = True
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first, second = np.flatnonzero(part == left), np.flatnonzero(part == right)
    kept = min(SHARED, min(map(len, near)))
    for lo in range(0, len(first), 256):
        a = first[lo : lo + 256]
        same = has[a] @ has[second].T >= kept
        if left == right:
            same &= a[:, None] < second[None, :]
        i, j = np.nonzero(same)
        i, j = a[i], second[j]
        for cut in range(0, len(i), 200_000):
            x, y = i[cut : cut + 200_000], j[cut : cut + 200_000]
            close = np.einsum("ij,ij->i", v[x], v[y]) / (norm[x] * norm[y]) >= COSINE
            x, y = x[close], y[close]
            own = (rank[x] & rank[y]).argmax(1) == pivot  # the first list that both are in
            x, y = x[own], y[own]
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p, q = find(p), find(q)
                root[max(p, q)] = min(p, q)
    used = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[used]), "links": pa.array(links[used]), "hub": pa.array(ids[[find(int(x)) for x in used]] if len(used) else ids[:0])})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = plain(vectors, id_col, label_col, vector_col).toDF("id", "label", "vector").where("id is not null")
    rows = rows.select("id", F.col("label").cast("long"), F.col("vector").cast("array<double>"))
    usable = cut_lineage(_classes(rows.where("label is not null and vector is not null")))
    classes = usable.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    mine = usable.select("id", "key")
    reps = cut_lineage(usable.join(classes.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("rep"))).dropDuplicates(["key"]).select("id", "label", "n", "vector", "key"))
    described = cut_lineage(_describe(reps.select("id", "label", "n", "vector"), _choose(reps, reps.count())))

    # the rarest pivots of each vector, by the length of their lists under its label
    told = described.select("id", "label", "width", F.explode("near").alias("pivot"))
    lengths = told.groupBy("label", "width", "pivot").agg(F.count("*").alias("length"))
    counts = lengths.groupBy("label", "width").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "length"))).alias("lengths"))  # at most MOST_PIVOTS entries
    ranked = described.join(counts, ["label", "width"]).withColumn("rare", F.expr("transform(array_sort(transform(near, x -> struct(lengths[x] as l, x as p))), y -> y.p)"))
    chosen = ranked.withColumn("posted", F.expr(f"slice(rare, 1, greatest(1, size(near) - {SHARED} + 1))")).drop("rare", "near_sorted", "lengths")
    posts = cut_lineage(chosen.select("id", "label", "width", "n", "vector", "near", "posted"))
    each = posts.select("*", F.explode("posted").alias("pivot"))
    sizes = posts.select("label", "width", F.explode("posted").alias("pivot")).groupBy("label", "width", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("length")).where("length > 1")
    dealt = each.join(sizes, ["label", "width", "pivot"]).withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    meet = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("label", "width", "pivot", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "id", "n", "vector", "near", "posted", "part")
    found = cut_lineage(meet.groupBy("label", "width", "pivot", "left", "right").applyInArrow(_meet, "id long, links long, hub long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    linked = components(found.select(F.col("id").alias("a"), F.col("hub").alias("b"))).select(F.col("id").alias("rep"), "component")

    per_class = classes.join(links, "rep", "left").join(linked, "rep", "left")
    done = mine.join(per_class, "key").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    apart = rows.select("id").join(mine.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionAll(apart).withColumn("kept", F.col("id") == F.col("component_id"))
