"""The toxicity network against plain loops, its gradients against finite differences, and the cover of its windows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import toxicity
from larder.llm.common import text_chunks


def text_of(*texts):
    _, _, data, offsets = next(text_chunks(pa.array(texts, pa.string())))
    return toxicity.Text(data, offsets)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_forward(p, x, number):
    """Probability of one window, one unit at a time."""
    hidden, spots = toxicity.HIDDEN, [t for t in range(len(number)) if number[t] >= 0]
    states = {t: [] for t in spots}
    for way in "fb":
        h = [0.0] * hidden
        u, w, c = p["h" + way], p["x" + way], p["c" + way]
        for t in spots if way == "f" else reversed(spots):
            own = x[number[t]]
            given = [sum(own[i] * w[i, j] for i in range(len(own))) + c[j] for j in range(3 * hidden)]
            back = [sum(h[i] * u[i, j] for i in range(hidden)) for j in range(3 * hidden)]
            new = []
            for k in range(hidden):
                z, r = sigmoid(given[k] + back[k]), sigmoid(given[hidden + k] + back[hidden + k])
                fresh = math.tanh(given[2 * hidden + k] + r * back[2 * hidden + k])
                new.append((1 - z) * fresh + z * h[k])
            h = new
            states[t] += h
    scores = {t: sum(p["v"][a] * math.tanh(sum(s[i] * p["att"][i, a] for i in range(2 * hidden))) for a in range(toxicity.ATTEND)) for t, s in states.items()}
    top = max(scores.values())
    share = {t: math.exp(v - top) for t, v in scores.items()}
    pooled = [sum(share[t] * states[t][i] for t in spots) / sum(share.values()) for i in range(2 * hidden)]
    return sigmoid(sum(a * b for a, b in zip(pooled, p["out"])) + p["b"][0])


def test_forward_equals_plain_loops():
    text = text_of("one two three, four! one", " ".join(f"w{k}" for k in range(50)), "é")
    row, number = text.windows()
    net = toxicity.Network(3)
    x = net.inputs(text)
    got = net.forward(x, number)[0]
    assert len(row) == 1 + 3 + 1
    assert got == pytest.approx([plain_forward(net.p, x, n) for n in number], abs=1e-5)


@pytest.mark.parametrize("kind", ["out", "b", "v", "att", "hf", "hb", "xf", "xb", "cf", "cb", "word", "char"])
def test_gradients_equal_finite_differences(kind):
    text = text_of("red green blue red", " ".join(["alpha beta gamma"] * 11), "delta red")
    row, number = text.windows()
    label, share = (row % 2).astype(np.float32), np.linspace(1, 2, len(row)).astype(np.float32)
    net = toxicity.Network(4)
    net.common = {"word": np.float32(1), "char": np.float32(1)}
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        """Weighted cross entropy by the plain forward pass."""
        p, x = net.p, net.p["char"]
        ends = np.append(0, np.cumsum(text.chars))
        x = [np.concatenate([p["word"][text.word_row[k]], p["char"][text.char_row[ends[k] : ends[k + 1]]].mean(0)]) for k in range(len(text.chars))]
        prob = [plain_forward(p, x, n) for n in number]
        each = [-math.log(q if y else 1 - q) for q, y in zip(prob, label)]
        return float(np.dot(each, share) / share.sum())

    before, moments = {k: v.copy() for k, v in net.p.items()}, {}
    net.m, net.s = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    net.learn(text, number, label, share, 0.0)
    moments = net.m[kind].ravel() / 0.1  # the first moment of the first step is a tenth of the gradient
    net.p = before
    flat = net.p[kind].reshape(-1)
    largest = np.argsort(-np.abs(moments))[:3]
    for spot in largest:
        kept = flat[spot]
        flat[spot] = kept + 1e-4
        up = loss()
        flat[spot] = kept - 1e-4
        down = loss()
        flat[spot] = kept
        assert moments[spot] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5)


@pytest.mark.parametrize("size", [1, 31, 32, 33, 47, 48, 49, 200])
def test_windows_cover_all_words_and_share_half(size):
    text = text_of(" ".join(f"w{k}" for k in range(size)), "other words")
    row, number = text.windows()
    mine = [set(n[n >= 0].tolist()) for n in number[row == 0]]
    assert set.union(*mine) == set(text.word[:size].tolist()) and len(text.word) == size + 2
    assert all(len(a & b) >= toxicity.SPAN // 2 for a, b in zip(mine, mine[1:]))
    starts = {w: k for k, w in enumerate(text.word[:size].tolist())}
    passages = [set(range(lo, lo + 16)) for lo in range(size - 15)]  # 16 words in a row lie whole in some window
    seen = [{starts[w] for w in m} for m in mine]
    assert all(any(p <= s for s in seen) for p in passages)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    params = toxicity.train(["bad bad words here"] * 8 + ["good words here"] * 8, [1] * 8 + [0] * 8)
    assert toxicity.score(docs, params).count() == 0
