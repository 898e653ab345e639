"""Language identification by prediction by partial matching (PPM) over bytes.

One pass counts, per language, every byte string of one to ``ORDER + 1`` bytes of all training texts (per-task counts
merge in a shuffle, so the counting grows with the corpus and no text reaches the driver). All of them are the context
tree; it is gathered and sent to the tasks, and grows with the distinct strings of ``ORDER + 1`` bytes, not with the text.
Escape probabilities are PPM method C: in a context seen t times with d different next bytes, a byte seen c times has
probability c / (t + d), and the escape to the next shorter context d / (t + d); below the empty context all 256 bytes
are equal. A context never seen is left without cost. Statistics are frozen: scoring updates nothing, so the code
length of a text is the sum over its bytes of a function of the last ``ORDER + 1`` bytes, which is exact and is
looked up by walking the tree for all bytes of a batch at once.

The language with the shortest code wins (ties: the first in order of name); ``score`` is its posterior probability
under equal priors. Null text and text without a letter are ``und`` with score 0. A table without training rows
gives ``und`` for all. Rows keep their multiplicity; other columns are ignored. Memory of a task is one model, with
an entry for each context and byte value that occur, and its longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.llm.common import chunks, give_back, plain, text_chunks

ORDER = 3
UNKNOWN = "und"
#: Bytes of text that are scored at once (a longer document is one piece); each byte takes some 100 bytes then.
PIECE = 1 << 17
#: Strings a task holds before it passes their counts on.
HELD = 1_000_000


def _grams(data: np.ndarray, offsets: np.ndarray):
    """The byte strings of ``ORDER + 1`` bytes in each row, as numbers (a row's start is padded by zeros), by row."""
    size = np.diff(offsets)
    wide = np.zeros(len(data) + ORDER * len(size), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    wide[np.arange(len(data)) + ORDER * (row + 1)] = data
    packed = np.zeros(len(wide) - ORDER, np.uint32) if len(wide) > ORDER else np.zeros(0, np.uint32)
    for k in range(ORDER + 1):
        packed = (packed << np.uint32(8)) | wide[k : k + len(packed)]
    return packed[np.arange(len(data)) + ORDER * row]


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all (lang, text): counts of full-length strings, merged per task before the shuffle."""

    def each(batches):
        give_back()
        held: dict[str, list] = {}

        def flush():
            for lang, parts in held.items():
                grams = np.concatenate([p[0] for p in parts])
                keys, inverse = np.unique(grams, return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                grams = _grams(data, offsets)
                row = np.repeat(langs[lo:hi], np.diff(offsets))
                for lang in sorted(set(langs[lo:hi].tolist())):
                    keys, n = np.unique(grams[row == lang], return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
                yield from flush()
        yield from flush()
        give_back()

    return rows.mapInArrow(each, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Language -> array of (gram, count), the frozen statistics."""
    rows = plain(docs, lang_col, text_col).toDF("lang", "text").where("lang is not null and text is not null")
    table = count_grams(rows).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    langs = np.array(table["lang"].to_pylist(), object)
    return {lang: np.stack([table["gram"].to_numpy()[langs == lang], table["n"].to_numpy()[langs == lang]], 1) for lang in sorted(set(langs.tolist()))}


class Trees:
    """Context trees of all languages, joined: one node for each string that any language has."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        per = []
        for lang in self.langs:
            gram, n = counts[lang].T
            per.append((gram.astype(np.uint64), n))
        # strings of each length end where the full string ends: the last k bytes
        keys = [np.zeros(1, np.uint64)]
        tallies = [np.array([[n.sum() for _, n in per]], float)]
        for k in range(1, ORDER + 2):
            cut = [(g & np.uint64((1 << (8 * k)) - 1), n) for g, n in per]
            every = np.unique(np.concatenate([g for g, _ in cut]))
            tally = np.zeros((len(every), len(per)))
            for c, (g, n) in enumerate(cut):
                np.add.at(tally[:, c], np.searchsorted(every, g), n)
            keys.append(every)
            tallies.append(tally)
        # code lengths: cost[k] of a string of k bytes, escape[k] of a context of k bytes
        self.alphabet = np.zeros(256, np.int64)
        self.alphabet[keys[1].astype(np.int64)] = np.arange(1, len(keys[1]) + 1)
        width = len(keys[1]) + 1
        cost, self.costs, self.escapes, self.children = np.full((1, len(per)), 8.0), [], [], []
        for k in range(1, ORDER + 2):
            context, symbol = keys[k] >> np.uint64(8), (keys[k] & np.uint64(255)).astype(np.int64)
            # a context of k - 1 bytes counts what follows it, so its total is over its children
            contexts = np.unique(context)
            at = np.searchsorted(contexts, context)
            total, kinds = np.zeros((len(contexts), len(per))), np.zeros((len(contexts), len(per)))
            np.add.at(total, at, tallies[k])
            np.add.at(kinds, at, tallies[k] > 0)
            seen = total > 0
            escape = np.where(seen, -np.log2(np.where(seen, kinds / np.maximum(total + kinds, 1), 1)), 0.0)
            shorter = cost[np.searchsorted(keys[k - 1], keys[k] & np.uint64((1 << (8 * (k - 1))) - 1))] if k > 1 else np.repeat(cost, len(keys[k]), 0)
            own = tallies[k] > 0
            here = -np.log2(np.where(own, tallies[k] / np.maximum((total + kinds)[at], 1), 1))
            cost = np.where(own, here, escape[at] + shorter)
            # node numbers: 0 is "not in the tree"
            parent = np.searchsorted(keys[k - 1], context)
            parent[parent == len(keys[k - 1])] = 0
            known = keys[k - 1][parent] == context
            child = np.zeros((len(keys[k - 1]) + 1, width), np.int32)
            child[parent[known] + 1, self.alphabet[symbol[known]]] = np.flatnonzero(known) + 1
            self.children.append(child.ravel())
            spot = np.searchsorted(contexts, keys[k - 1])
            spot[spot == len(contexts)] = 0
            full = np.zeros((len(keys[k - 1]) + 1, len(per)), np.float32)
            full[1:] = np.where((contexts[spot] == keys[k - 1])[:, None], escape[spot], 0)
            self.escapes.append(full)
            self.costs.append(np.concatenate([np.zeros((1, len(per))), cost]).astype(np.float32))
        self.width = width

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language."""
        parts = [self._lengths(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets, PIECE)]
        return np.concatenate([np.zeros((0, len(self.langs))), *parts])

    def _lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        symbol = self.alphabet[data].astype(np.int64)
        node, levels = np.ones(len(data), np.int32), []
        begins = offsets[:-1][np.diff(offsets) > 0]
        for k in range(ORDER + 1):
            before = np.empty(len(data), np.int32)  # node of the k bytes before
            if k == 0:
                before[:] = 1
            else:
                before[0], before[1:] = 0, node[:-1]
                before[begins] = 0
            node = self.children[k][before.astype(np.int64) * self.width + symbol]
            levels.append((before, node))
        bits = np.full((len(data), len(self.langs)), 8.0, np.float32)
        todo = np.arange(len(data))
        extra = np.zeros((len(data), len(self.langs)), np.float32)
        for k in range(ORDER, -1, -1):  # the longest string in the tree decides; above it only escapes are paid
            before, node = levels[k]
            found = node[todo] > 0
            hit, todo = todo[found], todo[~found]
            bits[hit] = self.costs[k][node[hit]] + extra[hit]
            extra[todo] += self.escapes[k][before[todo]]
        bits[todo] += extra[todo]
        rows = np.flatnonzero(np.diff(offsets) > 0)
        out[rows] = np.add.reduceat(bits.astype(np.float64), offsets[rows], axis=0)
        return out


def identify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, keep_text: bool = False) -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) of every row; ``carry`` names a further column to keep, ``keep_text`` keeps the text."""
    letters = F.coalesce(F.col(f"`{text_col}`").rlike("\\p{L}"), F.lit(False))
    more = [F.col(f"`{carry}`")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), letters.alias("letters"), *more)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["id", "lang_pred", "score", "bits_per_byte", *(["text"] if keep_text else []), *([carry] if carry else [])]

    def each(batches):
        give_back()
        trees = Trees(sent.value) if sent.value else None
        for batch in batches:
            langs, scores, rate = [], [], []
            letters = batch.column(2).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                if trees is None:
                    langs += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    rate += [8.0] * (hi - lo)
                    continue
                bits = trees.lengths(data, offsets)
                best = bits.argmin(1)
                odds = np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
                for r, b in enumerate(best):
                    ok = letters[lo + r]
                    langs.append(trees.langs[b] if ok else UNKNOWN)
                    scores.append(float(1 / odds[r]) if ok else 0.0)
                    rate.append(float(bits[r, b] / max(1, offsets[r + 1] - offsets[r])))
            made = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays([*made, *([batch.column(1)] if keep_text else []), *batch.columns[3:]], names=names)
        del trees
        give_back()

    result = StructType.fromDDL("id long, lang_pred string, score double, bits_per_byte double" + (", text string" if keep_text else ""))
    return rows.mapInArrow(each, result.add(docs.schema[carry]) if carry else result)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; rows without an id are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(modulus)) == remainder, F.lit(False))
