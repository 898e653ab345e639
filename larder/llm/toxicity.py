"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are two learned parts: an embedding of the word (hashed) and the mean of embeddings of its character
runs of three to five bytes (hashed), so unseen inflections and compounds are near what they contain. A text is read in
overlapping windows of ``SPAN`` words; in each, a gated recurrent unit runs in either direction, attention
pools the states, and the pooled state gives the window's probability. A text's score is that of its worst window.

Training takes a bounded sample: of each label the ``SAMPLE`` rows with the smallest hash of their id. Labels hold for
whole texts, so training goes in rounds: first every window has its text's label, then a toxic text lends its label
only to the windows that score highest, against all kinds of windows of clean texts and the worst of them.

Scoring reads all windows of every whole text in one pass without a shuffle; distinct words are turned into gate
inputs once a chunk. Defined cases: null or empty text and text without a word scores 0; without labelled rows of both
kinds every score is 0; null labels are no labels; repeated rows are scored each; a null id is kept; other columns are
ignored; an empty table gives an empty result. Memory of a task grows with its longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import MARKS, plain, prefix_hash, range_hash, text_chunks, words

SPAN = 32
#: Windows begin so many words apart; neighbours share the other half.
STEP = 16
HIDDEN = 8
WORD_DIM, CHAR_DIM = 8, 12
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 15
ATTEND = 8
#: Labelled documents of each class that training reads at most.
SAMPLE = 1200
LIMIT = 0.7
RARE = 6


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Text:
    """Words of a chunk of documents: number of each word among the distinct ones, and their hashed inputs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        hashed, _, self.at = words(data, offsets, MARKS)
        keys, first, self.word = np.unique(hashed, return_index=True, return_inverse=True)
        self.word_row = (keys % np.uint64(WORD_ROWS)).astype(np.int64)
        start = self._starts(data, offsets)[first] if len(first) else np.zeros(0, np.int64)
        end = self._ends[first] if len(first) else start
        size = end - start
        begin = np.cumsum(size + 2) - (size + 2)  # each distinct word between two marks
        flat = np.full(int((size + 2).sum()), 32, np.uint8)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin + 1, size) + inner] = data[np.repeat(start, size) + inner]
        prefix, rows, owner = prefix_hash(flat), [], []
        for n in (3, 4, 5):
            many = np.maximum(size + 2 - n + 1, 0)
            spot = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            rows.append((range_hash(prefix, spot, spot + n) % np.uint64(CHAR_ROWS)).astype(np.int32))
            owner.append(np.repeat(np.arange(len(size), dtype=np.int32), many))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.char_row, self.char_owner = rows[order], owner[order]
        self.chars = np.bincount(owner, minlength=len(size))

    def _starts(self, data, offsets):
        inside = ~MARKS[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self._ends = np.flatnonzero(last) + 1
        return np.flatnonzero(first)

    def windows(self):
        """(row, word numbers with -1 beyond the end) of all overlapping windows."""
        rows, spots = [], []
        size = np.diff(self.at)
        many = np.where(size > 0, np.maximum(1, -(-(size - SPAN) // STEP) + 1), 0)
        rows = np.repeat(np.arange(len(size)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = np.minimum(nth * STEP, np.maximum(size[rows] - SPAN, 0)) + self.at[:-1][rows]
        spots = start[:, None] + np.arange(SPAN)
        beyond = spots >= self.at[1:][rows][:, None]
        spots[beyond] = 0
        number = self.word[spots] if len(self.word) else spots
        number[beyond] = -1
        return rows, number


def _gather(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by index; negative indices are left out."""
    live = index >= 0
    width = values.shape[1]
    spots = (index[live].astype(np.int64)[:, None] * width + np.arange(width)).ravel()
    return np.bincount(spots, values[live].ravel(), size * width).reshape(size, width).astype(np.float32)


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        put = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": put(WORD_ROWS, WORD_DIM, scale=0.1), "char": put(CHAR_ROWS, CHAR_DIM, scale=0.3),
            "att": put(2 * HIDDEN, ATTEND, scale=0.3), "v": put(ATTEND, scale=0.3), "out": put(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.p["x" + way] = put(d, 3 * HIDDEN, scale=0.5 * d**-0.5)
            self.p["h" + way] = put(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            self.p["c" + way] = np.zeros(3 * HIDDEN, np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def drop_rare(self, text: Text) -> None:
        """Inputs that stand in fewer than ``RARE`` training texts stay zero, so no single text can be learned."""
        begin = np.cumsum(text.chars) - text.chars
        texts = {"word": np.zeros(WORD_ROWS, np.int64), "char": np.zeros(CHAR_ROWS, np.int64)}
        for lo, hi in zip(text.at[:-1], text.at[1:], strict=True):
            own = np.unique(text.word[lo:hi])
            many = text.chars[own]
            spot = np.repeat(begin[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            texts["word"][np.unique(text.word_row[own])] += 1
            texts["char"][np.unique(text.char_row[spot])] += 1
        self.common = {k: (n >= RARE).astype(np.float32)[:, None] for k, n in texts.items()}
        for kind, mask in self.common.items():
            self.p[kind] *= mask

    def inputs(self, text: Text) -> np.ndarray:
        p, n = self.p, len(text.word_row)
        chars = np.zeros((n, CHAR_DIM), np.float32)
        full = text.chars > 0
        if full.any():
            begin = (np.cumsum(text.chars) - text.chars)[full]
            chars[full] = np.add.reduceat(p["char"][text.char_row], begin, axis=0) / text.chars[full][:, None]
        return np.concatenate([p["word"][text.word_row], chars], 1)

    def _run(self, gates: np.ndarray, number: np.ndarray, way: str, keep: bool):
        """States of one direction, (step, window, unit), and what the way back needs."""
        n, u = len(number), self.p["h" + way]
        states, saved = np.empty((SPAN, n, HIDDEN), np.float32), []
        h = np.zeros((n, HIDDEN), np.float32)
        short = bool((number < 0).any())
        for t in range(SPAN) if way == "f" else range(SPAN - 1, -1, -1):
            g, uh = gates[number[:, t]], h @ u
            zr = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + uh[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * uh[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if short:
                new = np.where((number[:, t] >= 0)[:, None], new, h)
            if keep:
                saved.append((t, h, z, r, c, uh[:, 2 * HIDDEN :]))
            states[t] = h = new
        return states, saved

    def forward(self, x: np.ndarray, number: np.ndarray, keep: bool = False):
        p = self.p
        gates = {w: x @ p["x" + w] + p["c" + w] for w in "fb"}
        runs = {w: self._run(gates[w], number, w, keep) for w in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        hidden = np.tanh(states @ p["att"])
        weight = hidden @ p["v"]
        weight[(number < 0).T] = -1e9
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        prob = _sigmoid(pooled @ p["out"] + p["b"][0])
        return prob, (runs, states, hidden, weight, pooled)

    def learn(self, text: Text, number: np.ndarray, label: np.ndarray, share: np.ndarray, rate: float) -> None:
        """One Adam step on some windows of a text chunk."""
        used, local = np.unique(number, return_inverse=True)
        local = local.reshape(number.shape) - (used[0] < 0)
        used = used[used >= 0]
        part = _Part(text, used)
        p, x = self.p, self.inputs(part)
        prob, (runs, states, hidden, weight, pooled) = self.forward(x, local, True)
        d_logit = ((prob - label) * share / share.sum()).astype(np.float32)
        grad = {"out": d_logit @ pooled, "b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden**2)
        grad["v"] = np.einsum("tn,tna->a", d_score, hidden)
        grad["att"] = np.einsum("tnh,tna->ha", states, d_hidden)
        d_states = weight[:, :, None] * d_pooled[None] + d_hidden @ p["att"].T
        d_x = np.zeros_like(x)
        for w, lo in (("f", 0), ("b", HIDDEN)):
            u, d_h = p["h" + w], np.zeros((len(number), HIDDEN), np.float32)
            d_u, d_steps = np.zeros_like(u), np.zeros((SPAN, len(number), 3 * HIDDEN), np.float32)
            for t, h, z, r, c, uc in reversed(runs[w][1]):
                d_new = d_h + d_states[t][:, lo : lo + HIDDEN]
                real = (local[:, t] >= 0)[:, None]
                d_in = np.where(real, d_new, 0)
                d_c = d_in * (1 - z) * (1 - c * c)
                d_z = d_in * (h - c) * z * (1 - z)
                d_r = d_c * uc * r * (1 - r)
                into = np.concatenate([d_z, d_r, d_c * r], 1)
                d_h = np.where(real, d_in * z, d_new) + into @ u.T
                d_u += h.T @ into
                d_steps[t] = np.concatenate([d_z, d_r, d_c], 1)
            d_gate = _gather(local.T.ravel(), d_steps.reshape(-1, 3 * HIDDEN), len(x))
            grad["h" + w], grad["c" + w], grad["x" + w] = d_u, d_gate.sum(0), x.T @ d_gate
            d_x += d_gate @ p["x" + w].T
        each = d_x[:, WORD_DIM:] / np.maximum(part.chars, 1)[:, None]
        grad["word"] = _gather(part.word_row, d_x[:, :WORD_DIM], WORD_ROWS) * self.common["word"]
        grad["char"] = _gather(part.char_row, np.repeat(each, part.chars, 0), CHAR_ROWS) * self.common["char"]
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.99 * self.s[k] + 0.01 * g * g
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)

    def windows(self, text: Text, number: np.ndarray) -> np.ndarray:
        """Probability of each window."""
        x, out = self.inputs(text), np.zeros(len(number))
        whole = (number >= 0).all(1)
        for some in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for lo in range(0, len(some), 4096):
                out[some[lo : lo + 4096]] = self.forward(x, number[some[lo : lo + 4096]])[0]
        return out


class _Part:
    """Some of a text's distinct words."""

    def __init__(self, text: Text, used: np.ndarray):
        self.word_row, self.chars = text.word_row[used], text.chars[used]
        begin = np.cumsum(text.chars) - text.chars
        spot = np.repeat(begin[used], self.chars) + np.arange(self.chars.sum()) - np.repeat(np.cumsum(self.chars) - self.chars, self.chars)
        self.char_row = text.char_row[spot]


def train(texts: list[str], labels: list[int], seed: int = 5, batch: int = 256) -> dict[str, np.ndarray] | None:
    """Parameters of a network, or None without both kinds of labels."""
    label = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    column = pa.array([(t or "").lower() for t in texts], pa.string())
    raw = b"".join(t.encode() for t in column.to_pylist())
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in column.to_pylist()])]).astype(np.int64)
    text = Text(np.frombuffer(raw, np.uint8), offsets)
    row, number = text.windows()
    net, r = Network(seed), np.random.default_rng(seed)
    if not len(row):
        return None
    net.drop_rare(text)
    toxic, clean = np.flatnonzero(label[row] == 1), np.flatnonzero(label[row] == 0)
    if not len(toxic) or not len(clean):
        return None
    for turn, (epochs, rate) in enumerate(((2, 0.01), (2, 0.006), (2, 0.003), (2, 0.001))):
        good, bad = clean, toxic
        if turn:
            prob = net.windows(text, number)
            top = np.zeros(len(label))
            np.maximum.at(top, row, prob)
            bad = toxic[(prob[toxic] >= top[row[toxic]]) | (prob[toxic] > 0.9)]
            worst = clean[prob[clean] > 0.3]
            good = np.concatenate([clean, worst, worst])
        take = min(8192, max(4096, len(good), len(bad)))  # small samples are repeated
        for _ in range(epochs):
            some = np.concatenate([r.choice(good, take, len(good) < take), r.choice(bad, take // 2, len(bad) < take // 2)])
            r.shuffle(some)
            for lo in range(0, len(some), batch):
                part = some[lo : lo + batch]
                net.learn(text, number[part], label[row[part]], np.ones(len(part), np.float32), rate)
    return net.p


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE):
    """Texts and labels of at most ``sample`` rows of each label; ``usable`` is a condition on the id column."""
    given = plain(labels, id_col, label_col).toDF(id_col, "label").where(F.col(id_col).isNotNull() & usable)
    first = [given.where(F.col("label") == k).orderBy(F.xxhash64(id_col), id_col).limit(sample) for k in (0, 1)]
    picked = first[0].unionAll(first[1])  # a bounded table
    rows = plain(docs, id_col, text_col).toDF(id_col, "text").join(F.broadcast(picked), id_col).orderBy(id_col, "label", "text").collect()
    return [r.text for r in rows], [int(r.label) for r in rows]


def score(docs: DataFrame, params: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, windows) of every row."""
    rows = plain(docs, id_col, text_col).toDF("id", "text").select("id", F.lower("text").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(params)

    def each(batches):
        net = None
        if sent.value is not None:
            net = Network.__new__(Network)
            net.p = sent.value
        for batch in batches:
            top, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            if net is not None:
                for lo, hi, data, offsets in text_chunks(batch.column(1)):
                    text = Text(data, offsets)
                    row, number = text.windows()
                    if len(row):
                        np.maximum.at(top, lo + row, net.windows(text, number))
                        many[lo:hi] = np.bincount(row, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top), pa.array(many)], names=["id", "score", "windows"])

    return rows.mapInArrow(each, "id long, score double, windows long")
