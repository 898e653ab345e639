"""Helpers shared by the training-data operators: text batches as byte arrays, hashing, links to components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import cut_lineage

#: Bytes of text that are turned into number arrays at once (a longer document is one piece).
CHUNK = 1 << 20
_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra columns of any name cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def give_back() -> None:
    """Return to the system what earlier tasks of this worker have freed; workers outlive their tasks."""
    if len(_powers.get("up", ())) > CHUNK + 64:
        _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def giving_back(each):
    """``each(key, table)`` or ``each(key, table, table)``, after which the worker gives back what it freed: workers
    that wait for their next group are small while others work."""

    def done(*args):
        try:
            return each(*args)
        finally:
            give_back()

    def one(key, rows):
        return done(key, rows)

    def two(key, left, right):
        return done(key, left, right)

    return one if each.__code__.co_argcount == 2 else two  # Spark reads the number of arguments


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offset of each row (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, at least one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_chunks(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each chunk of an Arrow string column."""
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets, size):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the rolling-hash base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 64)
        with np.errstate(over="ignore"):
            for name, base in (("up", _R), ("down", _RINV)):
                p = np.full(size, _U(base))
                p[0] = 1
                _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix sums: entry i covers values[:i]."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(_U) + _U(1)) * up, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], equal for equal contents wherever they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start])


BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without bytes of ``between``, A-Z lower-cased): hash, row, and first word of each row.

    The last array has one entry per row and a closing one.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashed = range_hash(prefix_hash(_LOWER[data]), start, end)
    at = np.searchsorted(start, offsets)
    return hashed, np.repeat(np.arange(len(offsets) - 1), np.diff(at)), at


def shingles(hashed: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each row's word shingles in order, and where each row begins.

    A row of fewer words than ``width`` has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.diff(at)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(begin[-1], _U)
    with np.errstate(over="ignore"):
        if len(hashed) >= width:
            grams = np.zeros(len(hashed) - width + 1, _U)
            for j in range(width):
                grams = grams * _U(_R) + hashed[j : len(hashed) - width + 1 + j]
            long = np.flatnonzero(counts >= width)
            if len(long):
                reps = made[long]
                inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                out[np.repeat(begin[long], reps) + inner] = mix(grams[np.repeat(at[long], reps) + inner])
        for row in np.flatnonzero((counts > 0) & (counts < width)):
            x = _U(int(counts[row]))
            for h in hashed[at[row] : at[row + 1]]:
                x = x * _U(_R) + h
            out[begin[row]] = mix(np.array([x ^ _U(0xA5A5A5A5A5A5A5A5)]))[0]
    return out, begin


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``: the smallest id it can reach.

    Alternates the two star steps until nothing changes; every round is a map-side combined minimum and a join that
    Spark can split, so a hub with very many links is no single task. Each round is cut in the shared folder.
    """
    spark = edges.sparkSession
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = cut_lineage(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    members = now.groupBy("a").agg(F.min("b").alias("component"))
    return members.select(F.col("a").alias("id"), "component").unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
