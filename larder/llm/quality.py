"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of ``SPAN`` words; every byte is in exactly one. A passage's features are the hashed
three-byte strings it holds and a few shares (capitals, marks, digits, repeated words, ...); a layer encodes them. Gated
attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs a document's passages, and the weighted sum of their codes
gives the probability of label 1. Only documents have labels: encoder, gates and output are learned together from them.

Training takes a bounded sample: of each label the ``SAMPLE`` rows with the smallest hash of their id. Scoring reads every
passage of every whole text in one pass without a shuffle, ``PASSAGES`` of them at a time. Defined cases: a null or empty
text, or one without words, is one passage (an empty one has zero features); without labelled rows of both kinds every
score is 0.5; null labels are no labels; repeated rows are scored each; a null id is kept; other columns are ignored; an
empty table gives an empty result. Memory of a task grows with its longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import BLANKS, MARKS, plain, text_chunks, words

SPAN = 64
BUCKETS = 1024
SHARES = 10
HIDDEN, ATTEND = 24, 12
#: Labelled documents of each class that training reads at most.
SAMPLE = 1200
LIMIT = 0.7
#: Passages whose features are held at once.
PASSAGES = 2048
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE < 91)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE < 123)) | (_BYTE >= 192)
_DIGIT = (_BYTE >= 48) & (_BYTE < 58)
_SIGN = MARKS & ~BLANKS & ~np.isin(_BYTE, list(b".,;:'\"?-"))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Bags:
    """Passages of a chunk of documents: where each begins, and which document it is of."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        hashed, _, at = words(data, offsets)
        self.hashed = hashed
        size = np.diff(at)
        self.many = np.maximum(1, -(-size // SPAN))
        self.first = np.concatenate([[0], np.cumsum(self.many)])
        self.row = np.repeat(np.arange(len(size)), self.many)
        nth = np.arange(self.first[-1]) - self.first[self.row]
        self.word_at = np.append(np.minimum(at[:-1][self.row] + nth * SPAN, at[1:][self.row]), at[-1])
        inside = ~BLANKS[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        starts[edge] = inside[edge]
        spots = np.append(np.flatnonzero(starts), len(data))
        begin = np.where(nth == 0, offsets[:-1][self.row], spots[np.minimum(self.word_at[:-1], len(spots) - 1)])
        self.byte_at = np.append(begin, len(data))

    def features(self, lo: int, hi: int) -> np.ndarray:
        """Features of the passages from ``lo`` to ``hi``."""
        n, start, end = hi - lo, self.byte_at[lo], self.byte_at[hi]
        data, cuts = self.data[start:end], self.byte_at[lo : hi + 1] - start
        size = np.diff(cuts)
        owner = np.repeat(np.arange(n), size)
        out = np.zeros((n, BUCKETS + SHARES), np.float32)
        if not len(data):
            return out
        wide = data.astype(np.uint32)
        if len(data) > 2:
            code = ((wide[:-2] * np.uint32(65536) + wide[1:-1] * np.uint32(256) + wide[2:]) * np.uint32(2654435761)) >> np.uint32(22)
            whole = owner[:-2] == owner[2:]
            counts = np.bincount(owner[:-2][whole] * BUCKETS + code[whole], minlength=n * BUCKETS).reshape(n, BUCKETS)
            grams = np.sqrt(counts.astype(np.float32))
            out[:, :BUCKETS] = grams / np.maximum(np.sqrt((grams * grams).sum(1, keepdims=True)), 1)
        share = lambda flags, base: np.bincount(owner[flags[data]], minlength=n) / np.maximum(base, 1)
        letters = np.bincount(owner[_LETTER[data]], minlength=n)
        word_lo, word_hi = self.word_at[lo], self.word_at[hi]
        count = np.diff(self.word_at[lo : hi + 1])
        of = np.repeat(np.arange(n), count)
        hashed = self.hashed[word_lo:word_hi]
        order = np.lexsort((hashed, of))
        again = (hashed[order][1:] == hashed[order][:-1]) & (of[order][1:] == of[order][:-1])
        same = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
        many = lambda flags, base: np.bincount(of[1:][flags], minlength=n) / np.maximum(base, 1)
        rest = [
            share(_UPPER, letters), share(_SIGN, size), share(_DIGIT, size), share(MARKS, size), share(_BYTE == 10, size),
            share(_BYTE >= 128, size), np.bincount(of[order][1:][again], minlength=n) / np.maximum(count, 1), many(same, count),
            np.log1p(count) / 4, np.minimum(size / np.maximum(count, 1), 40) / 10,
        ]
        out[:, BUCKETS:] = np.stack(rest, 1)
        return out

    def parts(self):
        """(first passage, end passage) of bounded runs of passages."""
        for lo in range(0, int(self.first[-1]), PASSAGES):
            yield lo, min(lo + PASSAGES, int(self.first[-1]))


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        put = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "code": put(BUCKETS + SHARES, HIDDEN, scale=0.3), "code0": np.zeros(HIDDEN, np.float32),
            "tanh": put(HIDDEN, ATTEND, scale=HIDDEN**-0.5), "gate": put(HIDDEN, ATTEND, scale=HIDDEN**-0.5),
            "weigh": put(ATTEND, scale=ATTEND**-0.5), "out": put(HIDDEN, scale=0.3), "out0": np.zeros(1, np.float32),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["code"] + self.p["code0"])

    def pool(self, h: np.ndarray, first: np.ndarray):
        """Probability of each bag of codes, the weight of each passage, and what the way back needs."""
        p, begin, many = self.p, first[:-1], np.diff(first)
        t, g = np.tanh(h @ p["tanh"]), _sigmoid(h @ p["gate"])
        e = (t * g) @ p["weigh"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), many))
        weight = e / np.repeat(np.add.reduceat(e, begin), many)
        z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
        return _sigmoid(z @ p["out"] + p["out0"][0]), weight, (t, g, z)

    def gradients(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some bags."""
        p, many = self.p, np.diff(first)
        h = self.encode(x)
        prob, weight, (t, g, z) = self.pool(h, first)
        d_logit = (prob - label) / len(label)
        d_z = np.repeat(d_logit, many)[:, None] * p["out"]
        d_weight = (d_z * h).sum(1)
        mean = np.repeat(np.add.reduceat(weight * d_weight, first[:-1]), many)
        d_e = weight * (d_weight - mean)
        d_t, d_g = d_e[:, None] * p["weigh"] * g * (1 - t * t), d_e[:, None] * p["weigh"] * t * g * (1 - g)
        d_h = weight[:, None] * d_z + d_t @ p["tanh"].T + d_g @ p["gate"].T
        d_in = d_h * (1 - h * h)
        return {
            "out": d_logit @ z, "out0": d_logit.sum(keepdims=True), "weigh": d_e @ (t * g), "tanh": h.T @ d_t, "gate": h.T @ d_g,
            "code": x.T @ d_in, "code0": d_in.sum(0),
        }

    def step(self, grad: dict[str, np.ndarray], rate: float, decay: float) -> None:
        """Adam with decay of the weights."""
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
            change = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)
            self.p[k] -= (rate * (change + decay * self.p[k])).astype(np.float32)


def _bags(texts: list[str]) -> Bags:
    blobs = [(t or "").encode() for t in texts]
    return Bags(np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64))


def train(texts: list[str], labels: list[int], seed: int = 3, epochs: int = 32, batch: int = 32, rate: float = 0.004, decay: float = 0.003) -> dict[str, np.ndarray] | None:
    """Parameters of a network, or None without both kinds of labels."""
    if len(set(labels)) < 2:
        return None
    label, bags = np.array(labels, np.float32), _bags(texts)
    x = np.concatenate([bags.features(lo, hi) for lo, hi in bags.parts()])
    net, r = Network(seed), np.random.default_rng(seed)
    kinds = [np.flatnonzero(label == k) for k in (0, 1)]
    most = max(map(len, kinds))
    for epoch in range(epochs):
        some = np.concatenate([np.resize(r.permutation(k), most) for k in kinds])  # the rarer label is repeated
        r.shuffle(some)
        for lo in range(0, len(some), batch):
            part = some[lo : lo + batch]
            first = np.concatenate([[0], np.cumsum(bags.many[part])])
            spots = np.repeat(bags.first[:-1][part] - first[:-1], bags.many[part]) + np.arange(first[-1])
            net.step(net.gradients(x[spots], first, label[part]), rate * (1 - epoch / epochs), decay)
    return net.p


def score(docs: DataFrame, params: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages, heaviest, weight) of every row: the passage with the largest attention weight, and that weight."""
    sent = docs.sparkSession.sparkContext.broadcast(params)

    def each(batches):
        net = None
        if sent.value is not None:
            net = Network.__new__(Network)
            net.p = sent.value
        for batch in batches:
            n = batch.num_rows
            prob, many, heaviest, weight = np.full(n, 0.5), np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n)
            if net is not None:
                for lo, hi, data, offsets in text_chunks(batch.column(1)):
                    bags = Bags(data, offsets)
                    codes = np.concatenate([net.encode(bags.features(a, b)) for a, b in bags.parts()])
                    prob[lo:hi], own, _ = net.pool(codes, bags.first)
                    many[lo:hi] = bags.many
                    top = np.maximum.reduceat(own, bags.first[:-1])
                    spot = np.where(own == np.repeat(top, bags.many), np.arange(len(own)) - bags.first[bags.row], len(own))
                    heaviest[lo:hi], weight[lo:hi] = np.minimum.reduceat(spot, bags.first[:-1]), top
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (prob, many, heaviest, weight))], names=["id", "score", "passages", "heaviest", "weight"])

    rows = plain(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text")
    return rows.mapInArrow(each, "id long, score double, passages long, heaviest long, weight double")
