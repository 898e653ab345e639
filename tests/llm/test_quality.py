"""Quality network: plain loops, finite differences, passages, held-out labels and odd tables."""

import math
import random
import zlib

import numpy as np
import pytest

from larder.llm import quality, queries


def tiny():
    net = quality.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(2)
    x = np.zeros((7, quality.BUCKETS + quality.SHARES))
    x[:, :12] = r.standard_normal((7, 12))
    return net, x, np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])


def plain_scores(p, x, first):
    """The same network, number by number."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        codes = [[math.tanh(sum(x[k][i] * p["code"][i][j] for i in range(len(x[k])) if x[k][i]) + p["code0"][j]) for j in range(quality.HIDDEN)] for k in range(lo, hi)]
        marks = []
        for h in codes:
            total = 0.0
            for a in range(quality.ATTEND):
                dot = lambda m: sum(h[j] * m[j][a] for j in range(quality.HIDDEN))  # noqa: B023, E731
                total += p["weigh"][a] * math.tanh(dot(p["tanh"])) * sig(dot(p["gate"]))
            marks.append(math.exp(total))
        z = [sum(m * h[j] for m, h in zip(marks, codes)) / sum(marks) for j in range(quality.HIDDEN)]
        out.append(sig(sum(a * b for a, b in zip(z, p["out"])) + p["out0"][0]))
    return out


def test_network_equals_plain_loops():
    net, x, first, _ = tiny()
    assert np.allclose(net.pool(net.encode(x), first)[0], plain_scores(net.p, x, first), atol=1e-12)


def test_gradients_equal_finite_differences():
    net, x, first, label = tiny()

    def loss():
        prob = net.pool(net.encode(x), first)[0]
        return -np.mean(label * np.log(prob) + (1 - label) * np.log(1 - prob))

    grad, r = net.gradients(x, first, label), np.random.default_rng(3)
    for name, values in net.p.items():
        flat = values.reshape(-1)
        spots = r.integers(0, 12 * quality.HIDDEN if name == "code" else len(flat), 6)
        for i in spots:
            kept, h = flat[i], 1e-6
            flat[i] = kept + h
            up = loss()
            flat[i] = kept - h
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * h) - grad[name].reshape(-1)[i]) < 1e-7, name


def test_passages_cover_every_byte_once():
    texts = ["", "  ", "one", "w " * 64, "w " * 65, None, "é" * 500 + "\n" + " a" * 300, "x\ty " * 200]
    bags = quality._bags(texts)
    assert bags.byte_at[0] == 0 and bags.byte_at[-1] == len(bags.data) and (np.diff(bags.byte_at) >= 0).all()
    whole = bags.data.tobytes()
    for k, text in enumerate(texts):
        parts = [whole[bags.byte_at[i] : bags.byte_at[i + 1]].decode() for i in range(bags.first[k], bags.first[k + 1])]
        assert "".join(parts) == (text or "")
        counts = [len(p.split()) for p in parts]
        assert all(c == quality.SPAN for c in counts[:-1]) and counts[-1] <= quality.SPAN and len(counts) == max(1, -(-sum(counts) // quality.SPAN))


def sample_texts(n=260):
    rng = random.Random(6)
    names = [a + b for a in ("ba", "ke", "lo", "mi", "du") for b in ("ra", "ne", "st", "il", "o")]
    out = []
    for k in range(n):
        text = " ".join(rng.choice(names) for _ in range(rng.randint(10, 400)))
        out.append((k, text if k % 3 else " ".join(w + "$$$" for w in text.split()), int(bool(k % 3))))
    return out


def test_held_out_labels_are_found(spark, tmp_path):
    rows = sample_texts()
    spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(None, "plain words", "y", 0.1), (900, None, "y", 0.1), (901, "", "y", 0.1)], "doc_id long, text string, id string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op12_passage_attention"](spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, _ in rows} | {None, 900, 901}
    for i, _, q in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == (1 if got[i].score >= 0.7 else 0)
    held = [(q, got[i].predicted) for i, _, q in rows if got[i].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1 and got[900].passages == 1


def test_long_texts_cross_chunks_and_score_as_alone(spark, monkeypatch):
    rows = sample_texts(60)
    params = quality.train([t for _, t, _ in rows], [q for _, _, q in rows], epochs=2)
    texts = [rows[1][1] * 1500, rows[0][1] * 900, rows[2][1], "no_blank" * 200_000, ""]
    net = quality.Network.__new__(quality.Network)
    net.p = params
    alone = []
    for t in texts:
        bags = quality._bags([t])
        alone.append(float(net.pool(net.encode(bags.features(0, int(bags.first[-1]))), bags.first)[0][0]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.id: r for r in quality.score(frame, params).collect()}
    assert all(abs(got[k].score - s) < 1e-5 for k, s in enumerate(alone))
    assert sum(len(t) for t in texts) > 1 << 20 and got[0].passages > quality.PASSAGES


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_without_both_labels_or_rows(spark, tmp_path, labels):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, "en")] if labels else [], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op12_passage_attention"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.score, r.predicted) for r in got) == ([(1, 0.5, 0), (2, 0.5, 0)] if labels else [])
