"""Repeated byte passages by a depth-limited radix sort of suffixes.

Two suffixes that share their first ``WINDOW`` bytes share the smallest ``SEED``-byte hash among them, so a document's
suffixes need to be sorted only where such a minimum (an anchor) also occurs in another document:

1. first digit: every group of documents sends its distinct anchors to buckets, which answer with the shared ones;
2. the groups send the distinct surroundings (``WINDOW`` bytes to either side) of shared anchors with their smallest
   document; a bucket orders the suffixes in them by eight-byte digits, most significant first, drops those that are
   alone after each pass and stops at ``WINDOW`` bytes, so what is equal at the end is exactly a repeated window;
3. a bucket answers with the first document of each window, and the group cuts what it covers.

A passage that a third of all documents share is sent once by each group, whatever the number of its copies. All three
steps read one shuffle of the texts. Comparison is exact (bytes); hashes only choose candidates.

Defined cases: null text is empty; a null id has no order, so its text stays whole and removes nothing; rows with one id
are one document for the comparison and are returned each; an empty table gives an empty result; other columns are
ignored. A task holds one group of about ``GROUP`` bytes, or one longer document; number arrays are made for ``PIECE``
bytes of it at a time, and equal surroundings are found by a hash and a comparison, so they are held once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.llm.common import giving_back, mix, plain, prefix_hash, range_hash, text_bytes, text_chunks

WINDOW = 50
SEED = 16
#: Suffix starts that can share one anchor.
REACH = WINDOW - SEED + 1
GROUP = 8 << 20
#: Bytes of text that are turned into number arrays at once (a longer document is one piece).
PIECE = 1 << 18
_NONE = np.iinfo(np.int64).max
_WIDE = WINDOW + REACH - 1
#: Bytes of one surroundings as sent, with the lengths on both sides, and as held, in whole eight-byte numbers.
_SENT = _WIDE + 2
_HELD = -(-_SENT // 8) * 8
_OFFSETS = np.arange(REACH)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick() of each run of ``width`` values."""
    step, out = 1, values
    while step * 2 <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(data: np.ndarray, offsets: np.ndarray):
    """Position, row and 64-bit hash of the anchors of each row."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spots = np.arange(n - SEED + 1)
    hashed = range_hash(prefix_hash(data), spots, spots + SEED)
    short = np.clip((hashed >> np.uint64(32)).astype(np.uint32), 1, 0xFFFFFFFE)
    least = _sliding(short, REACH, np.minimum)
    for end in offsets[1:-1]:  # no window crosses into the next row
        least[max(0, end - WINDOW + 1) : end] = 0
    padded = np.zeros(len(short) + REACH - 1, np.uint32)
    padded[REACH - 1 : REACH - 1 + len(least)] = least
    at = np.flatnonzero(short == _sliding(padded, REACH, np.maximum))
    return at, np.searchsorted(offsets, at, "right") - 1, hashed[at]


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


_LOW = np.uint64((1 << 48) - 1)


def _six(hashed: np.ndarray) -> bytes:
    """Low six bytes of each hash; the bucket tells the rest, and a false match only adds a candidate."""
    return hashed.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blobs) -> np.ndarray:
    six = _array(blobs, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


def _group_anchors(tbl):
    """All anchors of a group: hash, document, and the chunk-wise positions."""
    ids, parts = tbl["id"].to_numpy(), []
    for lo, _, data, offsets in text_chunks(tbl["text"], PIECE):
        at, row, hashed = _anchors(data, offsets)
        parts.append((lo, data, offsets, at.astype(np.int32), row.astype(np.int32), hashed))
    hashed = np.concatenate([p[5] for p in parts] or [np.zeros(0, np.uint64)])
    docs = np.concatenate([ids[p[0] + p[4]] for p in parts] or [np.zeros(0, np.int64)])
    return ids, parts, hashed, docs


def _many_documents(hashed, docs):
    """Hashes that stand in more than one document."""
    order = np.lexsort((docs, hashed))
    h, d = hashed[order], docs[order]
    return np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])


def _content_hash(block: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of ``block``; it only puts rows next to each other that may be equal."""
    out = np.zeros(len(block), np.uint64)
    for word in block.view(np.uint64).T:
        out = mix(out ^ word)
    return out


def _alike(block: np.ndarray):
    """First row of each kind of equal rows, and each row's kind; kinds come in an order that their bytes decide."""
    n = len(block)
    hashed = _content_hash(block)
    order = np.argsort(hashed, kind="stable")

    def compared():
        new = np.ones(n, bool)
        for lo in range(1, n, 50_000):
            some = order[lo - 1 : lo + 50_000]
            new[lo : lo + 50_000] = (block[some[1:]] != block[some[:-1]]).any(1)
        return new

    new, ranked = compared(), hashed[order]
    clash = np.unique(ranked[1:][new[1:] & (ranked[1:] == ranked[:-1])])
    if len(clash):  # one hash for different rows: their bytes decide the order among them
        rank = np.zeros(n, np.int64)
        rows = np.flatnonzero(np.isin(hashed, clash))
        rank[rows] = np.unique(block[rows].view(f"V{_HELD}").ravel(), return_inverse=True)[1]
        order = np.lexsort((rank, hashed))
        new = compared()
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def _surroundings(tbl, shared: np.ndarray):
    """For shared anchors: per occurrence chunk, position, row and surroundings' number; the bytes of all occurrences,
    and per surroundings the first occurrence, hash and smallest document, in a fixed order."""
    ids, parts, hashed, docs = _group_anchors(tbl)
    wanted = np.union1d(shared, _many_documents(hashed, docs) & _LOW)
    keep = np.isin(hashed & _LOW, wanted)
    hashed, owner = hashed[keep], docs[keep]
    del docs, wanted
    sizes = np.cumsum([0] + [len(p[3]) for p in parts])
    chunk = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(sizes))[keep]
    at, row = (np.concatenate([p[j] for p in parts] or [np.zeros(0, np.int32)])[keep] for j in (3, 4))
    parts = [p[:3] for p in parts]
    block = np.zeros((len(at), _HELD), np.uint8)
    ends = np.searchsorted(chunk, np.arange(len(parts) + 1))
    for (_, data, offsets), lo, hi in zip(parts, ends[:-1], ends[1:], strict=True):
        for some in (slice(k, min(k + 10_000, hi)) for k in range(lo, hi, 10_000)):
            here, begin, end = at[some].astype(np.int64), offsets[row[some]], offsets[row[some] + 1]
            spot = here[:, None] + np.arange(1 - REACH, WINDOW)
            inside = (spot >= begin[:, None]) & (spot < end[:, None])
            block[some, :_WIDE][inside] = data[spot[inside]]
            block[some, _WIDE], block[some, _WIDE + 1] = np.minimum(REACH - 1, here - begin), np.minimum(WINDOW, end - here)
    first, number = _alike(block)
    least = np.full(len(first), _NONE)
    np.minimum.at(least, number, owner)
    return ids, parts, (chunk, at, row, number), block, first, hashed[first], least


def _first_documents(block: np.ndarray, kinds: np.ndarray, owner: np.ndarray):
    """First document of each window in the rows ``kinds`` of ``block`` by radix passes: one number for surroundings
    whose windows agree, else a mark and a number for each window (column: bytes before the anchor)."""
    one, rows, uneven = owner.copy(), [np.zeros(0, np.int64)], [np.zeros((0, REACH), np.int64)]
    core = np.ascontiguousarray(block[kinds, REACH - 1 : REACH - 1 + SEED]).view(f"V{SEED}").ravel()
    _, anchor, size = np.unique(core, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[anchor] > 1)
    several = several[np.argsort(anchor[several], kind="stable")]
    cuts = np.append(np.flatnonzero(np.diff(anchor[several], prepend=-1)), len(several))
    lo = 0
    while lo < len(several):  # whole anchors, about 20,000 surroundings at a time
        nxt = cuts[min(np.searchsorted(cuts, lo + 20_000), len(cuts) - 1)]
        own = several[lo:nxt]
        lo = nxt
        first = np.repeat(owner[own][:, None], REACH, 1)
        flat = np.ascontiguousarray(block[kinds[own], :_WIDE]).ravel()
        left, right = block[kinds[own], _WIDE].astype(int), block[kinds[own], _WIDE + 1].astype(int)
        row, before = np.nonzero((_OFFSETS[None, :] <= left[:, None]) & (WINDOW - _OFFSETS[None, :] <= right[:, None]))
        group = anchor[own][row] * REACH + before
        for depth in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
            at = row * _WIDE + REACH - 1 - before + depth
            digit = np.zeros(len(at), np.uint64)
            for j in range(8):
                digit = (digit << np.uint64(8)) | flat[at + j]
            order = np.lexsort((digit, group))
            g, d = group[order], digit[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
            label = np.cumsum(new) - 1
            kept = np.bincount(label, minlength=1)[label] > 1
            order, group = order[kept], label[kept]
            row, before = row[order], before[order]
            if not len(row):
                break
        if len(row):
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            least = np.minimum.reduceat(owner[own[row]], starts)
            first[row, before] = np.repeat(least, np.diff(np.append(starts, len(row))))
        odd = (first != first[:, :1]).any(1)
        one[own] = np.where(odd, -_NONE, first[:, 0])
        rows.append(own[odd])
        uneven.append(first[odd])
    rows, uneven = np.concatenate(rows), np.concatenate(uneven)
    order = np.argsort(rows)
    return one, rows[order], uneven[order]


def _binary(parts) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())


def _array(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, as_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row; ``kept`` is the remaining bytes, ``carry`` names a further
    column that goes along and is returned under its name. With ``as_text`` they are text, in which what is left of a
    cut character is left out; the task that cuts makes it, so that no second Python worker stands beside each."""
    more_names = ["carry"] if carry else []
    kept_kind = pa.string() if as_text else pa.binary()
    docs = plain(docs, id_col, text_col, *([carry] if carry else [])).toDF("id", "text", *more_names)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(4, -(-size // GROUP))
    buckets = max(4, groups // 2)
    dealt = docs.where("id is not null").select("id", "text", *more_names, F.expr(f"cast(pmod(xxhash64(id), {groups}) as int)").alias("g")).repartition(groups, "g")
    by_group = dealt.groupBy("g")

    @giving_back
    def send(key, tbl):
        _, _, hashed, _ = _group_anchors(tbl)
        hashed = np.unique(hashed)
        to = _bucket(hashed, buckets)
        used = np.unique(to)
        return pa.table({"bucket": pa.array(used, pa.int32()), "g": pa.array([key[0].as_py()] * len(used), pa.int32()), "blob": pa.array([_six(hashed[to == b]) for b in used], pa.binary())})

    @giving_back
    def shared(key, tbl):
        blobs, g = tbl["blob"].to_pylist(), tbl["g"].to_numpy()
        hashed = _from_six(blobs)
        order = np.argsort(hashed, kind="stable")
        h = hashed[order]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        back = np.zeros(len(h), bool)
        back[order] = twice
        ends = np.cumsum([len(b) // 6 for b in blobs])
        pieces = [x[m] for x, m in zip(np.split(hashed, ends[:-1]), np.split(back, ends[:-1]), strict=True)]
        return pa.table({"g": pa.array(g, pa.int32()), "bucket": pa.array([-1] * len(g), pa.int32()), "blob": pa.array([_six(x) for x in pieces], pa.binary()), "extra": _binary([b""] * len(g))})

    @giving_back
    def surround(key, tbl, answers):
        if not len(tbl):
            return pa.table({"bucket": pa.array([], pa.int32()), "g": pa.array([], pa.int32()), "blob": _binary([]), "docs": _binary([])})
        *_, block, first, hashed, least = _surroundings(tbl, _from_six(answers["blob"].to_pylist()))
        to = _bucket(hashed, buckets)
        used = np.unique(to)
        return pa.table({"bucket": pa.array(used, pa.int32()), "g": pa.array([key[0].as_py()] * len(used), pa.int32()), "blob": pa.array([pa.compress(np.ascontiguousarray(block[first[to == b], :_SENT]), "zstd", asbytes=True) for b in used], pa.binary()), "docs": _binary(least[to == b] for b in used)})

    @giving_back
    def sort(key, tbl):
        blobs = tbl["docs"].to_pylist()
        owner = _array(blobs, np.int64)
        block, done = np.zeros((len(owner), _HELD), np.uint8), 0
        for x, d in zip(tbl["blob"], blobs, strict=True):
            n = len(d) // 8
            block[done : done + n, :_SENT] = np.frombuffer(pa.decompress(x.as_buffer(), n * _SENT, "zstd"), np.uint8).reshape(n, _SENT)
            done += n
        kinds, number = _alike(block)
        least = np.full(len(kinds), _NONE)
        np.minimum.at(least, number, owner)
        one, rows, every = _first_documents(block, kinds, least)
        del block
        plain_first, uneven = [], []
        for part in np.split(number, np.cumsum([len(b) // 8 for b in blobs])[:-1]):
            plain_first.append(one[part])
            odd = every[np.searchsorted(rows, part[one[part] == -_NONE])]
            uneven.append(pa.compress(odd, "zstd", asbytes=True) if len(odd) else b"")
        return pa.table({"g": tbl["g"].combine_chunks().cast(pa.int32()), "bucket": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "blob": _binary(plain_first), "extra": pa.array(uneven, pa.binary())})

    @giving_back
    def cut(key, tbl, answers):
        if not len(tbl):
            return pa.table({"id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], kept_kind)} | {c: tbl[c] for c in more_names})
        bucket = answers["bucket"].to_numpy()
        blobs, extra = answers["blob"].to_pylist(), answers["extra"].to_pylist()
        ids, parts, (chunk, at, row, number), block, found, hashed, _ = _surroundings(tbl, _from_six([b for b, k in zip(blobs, bucket, strict=True) if k < 0]))
        left, right = (block[found, _WIDE + j].astype(np.int16) for j in (0, 1))
        del block
        one, place, every, known = np.full(len(found), _NONE), np.zeros(len(found), np.int64), [], 0
        to = _bucket(hashed, buckets)
        for b, same, more in zip(bucket, blobs, extra, strict=True):
            if b >= 0:
                mine, same = np.flatnonzero(to == b), np.frombuffer(same, np.int64)
                one[mine] = same
                odd = mine[same == -_NONE]
                place[odd] = known + np.arange(len(odd))
                known += len(odd)
                if len(odd):
                    every.append((more, len(odd)))
        del blobs, extra
        windows, done = np.zeros((known + 1, REACH), np.int64), 0
        for more, n in every:
            windows[done : done + n] = np.frombuffer(pa.decompress(more, n * REACH * 8, "zstd"), np.int64).reshape(n, REACH)
            done += n
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for k, (lo, data, offsets) in enumerate(parts):
            change = np.zeros(len(data) + 1, np.int32)
            mine = np.flatnonzero(chunk == k)
            for some in np.array_split(mine, max(1, len(mine) // 20_000)):
                n = number[some]
                first = np.where((one[n] == -_NONE)[:, None], windows[place[n]], one[n][:, None])
                whole = (_OFFSETS[None, :] <= left[n][:, None]) & (WINDOW - _OFFSETS[None, :] <= right[n][:, None])
                hit, before = np.nonzero(whole & (first < ids[lo + row[some]][:, None]))
                start = at[some][hit] - before
                change += np.bincount(start, minlength=len(change)).astype(np.int32)
                change -= np.bincount(start + WINDOW, minlength=len(change)).astype(np.int32)
            gone = np.cumsum(change[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            opens[inner] = gone[inner]
            spans, removed = (np.concatenate([[0], np.cumsum(x)]) for x in (opens, gone))
            n_bytes += list(np.diff(offsets))
            n_removed += list(np.diff(removed[offsets]))
            n_spans += list(np.diff(spans[offsets]))
            for i in range(len(offsets) - 1):
                own = slice(offsets[i], offsets[i + 1])
                left_over = data[own][~gone[own]].tobytes()
                kept.append(left_over.decode("utf-8", "ignore") if as_text else left_over)
        return pa.table({"id": tbl["id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, kept_kind)} | {c: tbl[c] for c in more_names})

    answer = "g int, bucket int, blob binary, extra binary"
    sent = by_group.applyInArrow(send, "bucket int, g int, blob binary")
    common = sent.groupBy("bucket").applyInArrow(shared, answer)
    around = by_group.cogroup(common.groupBy("g")).applyInArrow(surround, "bucket int, g int, blob binary, docs binary")
    firsts = around.groupBy("bucket").applyInArrow(sort, answer)
    result = StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary"))
    if carry:
        result = result.add(docs.schema["carry"])
    done = by_group.cogroup(common.unionAll(firsts).groupBy("g")).applyInArrow(cut, result)
    uncut = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    whole = docs.where("id is null").select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (F.decode(uncut, "utf-8") if as_text else uncut).alias("kept"), *more_names)
    out = done.unionAll(whole)
    return out.withColumnRenamed("carry", carry) if carry else out
