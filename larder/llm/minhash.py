"""MinHash near-duplicates by an inverted join over signature coordinates.

Every class of equal shingle sets is posted once, under each (coordinate, value) of its signature's prefix. Two sets
that agree in at least ``MATCHES`` of ``COORDINATES`` places must agree in one of the first
``COORDINATES - MATCHES + 1``, so only those are posted (prefix) and a pair belongs to the first of them in which it
agrees (the others skip it). Inside a list, members are in order of set size, so a member meets only those whose size
allows the similarity (the rest is skipped unread). A byte sketch of the smallest hashes in ``BINS`` ranges is
compared first, then the full collision count is taken, and a pair at or above ``MATCHES`` is confirmed on the full
sets. A pair at Jaccard 0.75 falls below 22 of 48, or below the sketch's bound, with probability under 1e-5.

Long lists never become pairs. First each list is compared with one member of its own (a star, linear); members that
this links are one component afterwards. Then only members of different components are compared, in blocks of
``BLOCK`` rows, so a hot list is many tasks. What such a task finds leaves it as one row a member with its partners at or
above ``MATCHES``, never as pairs, and full sets are fetched once for a member and task; cells bound the sets in a task.

Defined cases: null or empty text and text of blanks only has no shingles and links with nothing; fewer than five words
are one shingle; repeated rows and equal texts are copies of one class; a null id is no document and is left out; an
empty table gives an empty result; other columns are ignored. Memory of a task grows with the longest document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, give_back, mix, plain, shingles, text_chunks, words
from larder.session import cut_lineage

COORDINATES = 48
MATCHES = 22
WORDS = 5
PERCENT = 75
#: Rows of a posting list that one task compares with another such block.
BLOCK = 2048
BINS = 128
#: Shingle hashes of either side that one task confirms at once (a longer set is a cell of its own).
CELL = 2_000_000
#: Up to so many ids (16 bytes each) are sent to all tasks to pick texts; beyond, texts are joined by a shuffle.
SENT_IDS = 1_000_000

_seeds = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64)


def shingle_sets(column) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of an Arrow column."""
    out = []
    for lo, hi, data, offsets in text_chunks(column):
        hashed, _, at = words(data, offsets)
        grams, begin = shingles(hashed, at, WORDS)
        out += [np.unique(grams[begin[i] : begin[i + 1]]) for i in range(hi - lo)]
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum of each scrambled order over each set; rows of empty sets are zero."""
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    for lo in range(0, len(full), 256):
        rows = full[lo : lo + 256]
        lens = np.array([len(sets[i]) for i in rows])
        every, begin = np.concatenate([sets[i] for i in rows]), np.cumsum(lens) - lens
        with np.errstate(over="ignore"):
            for c in range(COORDINATES):
                x = (every ^ _seeds[0, c]) * (_seeds[1, c] | np.uint64(1))
                out[rows, c] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), begin)
    return mix(out)


_EDGES = np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS)


def _sketch(hashes: np.ndarray) -> bytes:
    """A byte of the smallest hash in each range, 0 where there is none; ``hashes`` is sorted."""
    at = np.searchsorted(hashes, _EDGES)
    filled = np.append(at[1:], len(hashes)) > at
    out = np.zeros(BINS, np.uint8)
    out[filled] = (hashes[at[filled]] >> np.uint64(20)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _alike(sketches: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether two sketches leave the wanted similarity possible."""
    either = np.count_nonzero(sketches | own, axis=1)
    same = np.count_nonzero((sketches == own) & (own > 0), axis=1)
    return (either < 16) | (100 * same >= np.where(either >= 96, 55, 42) * either)


def features(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, digest of the set, sketch, signature) of each (id, text)."""

    def each(batches):
        give_back()
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            sig = _signatures(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([_sketch(s) for s in sets], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), COORDINATES).cast(pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "digest", "sketch", "sig"],
            )
        give_back()

    return docs.mapInArrow(each, "id long, n_shingles long, digest binary, sketch binary, sig array<long>")


def _reach(n: np.ndarray, own: int) -> tuple[int, int]:
    """Range of the sorted sizes that allow the wanted similarity to a set of ``own``."""
    return int(np.searchsorted(n, -(-PERCENT * own // 100))), int(np.searchsorted(n, 100 * own // PERCENT, "right"))


def _star(coord, ids, n, sketch, sig, comp, part, left, right):
    """Pairs of one member of a list, chosen by hash, with the members that collide often enough."""
    hub = int(np.argmin(mix(ids.astype(np.uint64) * np.uint64(64) + np.uint64(coord))))
    lo, hi = _reach(n, int(n[hub]))
    hit = lo + np.flatnonzero(_alike(sketch[lo:hi], sketch[hub]))
    hit = hit[((sig[hit] == sig[hub]).sum(1) >= MATCHES) & (hit != hub)]
    yield np.full(len(hit), ids[hub]), ids[hit]


def _across(coord, ids, n, sketch, sig, comp, part, left, right):
    """Pairs from different components that collide often enough and agree first in this list's coordinate."""
    if (comp == comp[0]).all():
        return
    a, b = np.flatnonzero(part == left), np.flatnonzero(part == right)
    n_b, sketch_b, comp_b = n[b], sketch[b], comp[b]
    for nth, i in enumerate(a):
        lo, hi = _reach(n_b, int(n[i]))
        if left == right:
            lo = nth + 1
        if lo < hi:
            j = b[lo:hi][_alike(sketch_b[lo:hi], sketch[i]) & (comp_b[lo:hi] != comp[i])]
            if len(j):
                same = sig[j] == sig[i]
                j = j[(same.sum(1) >= MATCHES) & (same[:, : COORDINATES - MATCHES + 1].argmax(1) == coord)]
                yield np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])


def _as_pairs(key, ids, n, x, y):
    return pa.table({"a": pa.array(x), "b": pa.array(y)})


def _as_partners(key, ids, n, x, y):
    """One row for each member of a pair, with its partners of larger id, in cells of bounded set size."""
    every, at = np.unique(ids, return_index=True)
    chunk = (np.cumsum(n[at]) - n[at]) // CELL
    i, j = np.searchsorted(every, x), np.searchsorted(every, y)
    cell = chunk[i] * (chunk.max(initial=0) + 1) + chunk[j]
    left, right = cell * len(every) + i, cell * len(every) + j
    order = np.argsort(left, kind="stable")
    rows = np.unique(np.concatenate([left, right]))
    begin = np.append(np.searchsorted(left[order], rows), len(left)).astype(np.int32)
    columns = {
        "coord": np.full(len(rows), key[0].as_py(), np.int32),
        "share": np.full(len(rows), key[1].as_py(), np.int64),
        "cell": rows // len(every),
        "id": every[rows % len(every)],
    }
    partners = pa.ListArray.from_arrays(pa.array(begin), pa.array(y[order]))
    return pa.table({c: pa.array(v) for c, v in columns.items()} | {"partners": partners})


def _lists(pairs_of, shape):
    """Run ``pairs_of`` on each list of a group of lists; members are in order of size and id."""

    def run(key, tbl):
        name = {c: tbl[c].to_numpy() for c in ("value", "left", "right", "id", "n", "component", "part")}
        order = np.lexsort((name["id"], name["n"], name["right"], name["left"], name["value"]))
        value, left, right, ids, n, comp, part = (name[c][order] for c in name)
        sketch = np.frombuffer(b"".join(tbl["sketch"].to_pylist()), np.uint8).reshape(len(ids), BINS)[order]
        sig = np.frombuffer(b"".join(tbl["short"].to_pylist()), np.uint32).reshape(len(ids), COORDINATES)[order]
        new = np.ones(len(ids), bool)
        new[1:] = (value[1:] != value[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        cuts = np.append(np.flatnonzero(new), len(ids))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo > 1:
                own = slice(lo, hi)
                found += pairs_of(key[0].as_py(), ids[own], n[own], sketch[own], sig[own], comp[own], part[own], left[lo], right[lo])
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        return shape(key, ids, n, x, y)

    return run


def _similar(hub: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each set is similar enough to ``hub``; all are sorted and none is empty."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    at = np.searchsorted(hub, every)
    at[at == len(hub)] = 0
    both = np.add.reduceat((hub[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= PERCENT * (len(hub) + sizes - both)


def _confirm_cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of (id, partners) rows whose full sets are similar enough; each cell holds all sets it needs."""

    def check(tbl):
        own = {i: np.frombuffer(blob, np.uint64) for i, blob in zip(tbl["id"].to_pylist(), tbl["hashes"].to_pylist(), strict=True)}
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, partners in zip(tbl["id"].to_pylist(), tbl["partners"], strict=True):
            partners = partners.values.to_numpy()
            for lo in range(0, len(partners), 256):
                some = partners[lo : lo + 256]
                b.append(some[_similar(own[i], [own[j] for j in some.tolist()])])
                a.append(np.full(len(b[-1]), i))
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return members.join(sets, "id").groupBy("coord", "share", "cell").applyInArrow(check, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough; a hub's partners are dealt over tasks of 256."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.expr("cast(pmod(xxhash64(b), parts) as int)"))
    members = dealt.join(sets, dealt.b == sets.id).select("a", "part", "b", "hashes")
    hubs = dealt.select("a", "part").distinct().join(sets, F.col("a") == sets.id).select("a", "part", F.lit(None).cast("long").alias("b"), "hashes")

    def check(tbl):
        ids, blobs = tbl["b"].to_pylist(), tbl["hashes"].to_pylist()
        hub = np.frombuffer(blobs[ids.index(None)], np.uint64)
        rest = [(b, np.frombuffer(blob, np.uint64)) for b, blob in zip(ids, blobs, strict=True) if b is not None]
        good = _similar(hub, [own for _, own in rest])
        kept = [b for (b, _), ok in zip(rest, good, strict=True) if ok]
        a = tbl["a"][0].as_py()
        return pa.table({"a": pa.array([a] * len(kept), pa.int64()), "b": pa.array(kept, pa.int64())})

    return members.unionByName(hubs).groupBy("a", "part").applyInArrow(check, "a long, b long")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, sorted shingle hashes) of the documents with these ids."""
    ids = ids.distinct()
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)

    def each(batches):
        for batch in batches:
            blobs = pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], names=["id", "hashes"])

    return docs.join(ids, "id", "left_semi").mapInArrow(each, "id long, hashes binary").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, class_id) per row: the class is the smallest id with an equal set."""
    docs = plain(docs, id_col, text_col).toDF("id", "text").where("id is not null")
    feats = cut_lineage(features(docs))
    full = feats.where("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("id").alias("class_id"))
    reps = cut_lineage(
        full.join(classes.select(F.col("digest").alias("d"), "class_id"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("class_id")))
        .dropDuplicates(["id"])
        .select("id", F.col("n_shingles").alias("n"), "sketch", "sig")
    )
    prefix = COORDINATES - MATCHES + 1
    posts = reps.select("id", "n", "sig", F.posexplode(F.slice("sig", 1, prefix)).alias("coord", "value"))
    shared = posts.groupBy("coord", "value").agg(F.count("*").alias("length")).where("length > 1")
    short = F.expr("unhex(aggregate(sig, '', (s, x) -> s || right(lpad(hex(x), 16, '0'), 8)))")
    signed = reps.select("id", "sketch", short.alias("short"))
    lists = cut_lineage(posts.drop("sig").join(shared, ["coord", "value"]))
    rows = lists.join(signed, "id")

    # a list too long for one task is cut by hash; every block has its own hub, and all blocks meet in the second step.
    # Short lists share a task: about ``BLOCK`` rows of one coordinate.
    parts = F.ceil(F.col("length") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("id", "coord"), parts).cast("int")

    def joined(rows: DataFrame, many: int, pairs_of, shape, schema: str) -> DataFrame:
        share = F.pmod(F.xxhash64("value", "left", "right"), F.lit(max(1, many // (prefix * BLOCK)))).alias("share")
        chosen = rows.select("coord", share, "value", "left", "right", "id", "n", "component", "part", "sketch", "short")
        return chosen.groupBy("coord", "share").applyInArrow(_lists(pairs_of, shape), schema)

    blocks = rows.withColumn("part", part).withColumn("left", F.col("part")).withColumn("right", F.col("part")).withColumn("component", F.col("id"))
    stars = cut_lineage(joined(blocks, lists.count(), _star, _as_pairs, "a long, b long").distinct())
    sets = cut_lineage(_sets_of(docs, stars.select("a").unionAll(stars.select("b")).toDF("id")))
    first = cut_lineage(_confirm(stars, sets))
    merged = components(first)

    labelled = lists.join(merged, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("coord", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("coord", "value")
    open_ = cut_lineage(labelled.join(mixed, ["coord", "value"]).withColumn("parts", parts).withColumn("part", part))
    meeting = open_.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]  # every row meets each block of its list
    meet = open_.join(signed, "id").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
    cross = cut_lineage(joined(meet, meeting, _across, _as_partners, "coord int, share long, cell long, id long, partners array<long>"))
    more = _confirm_cells(cross, _sets_of(docs, cross.select("id")))
    links = cut_lineage(first.unionAll(more))

    linked = components(links).withColumnRenamed("id", "class_id").withColumnRenamed("component", "linked")
    out = feats.join(classes, "digest", "left").join(linked, "class_id", "left")
    empty = F.col("n_shingles") == 0
    own = F.when(empty, F.col("id")).otherwise(F.coalesce("linked", "class_id"))
    return out.select("id", "n_shingles", own.alias("component_id"), (F.col("id") == own).alias("kept"), F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
