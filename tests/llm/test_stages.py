"""Every stage of the corpus pipeline against plain Python: exact rows of the filters, whole texts in the windows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np

from larder.llm import ppm
from larder.llm.encoding import Encoder
from larder.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, names, n):
    return " ".join(rng.choices(names, k=n))


def fixture():
    rng = random.Random(12)
    words = lambda letters: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(400)]
    names = {"aa": words("abcdefghij"), "bb": words("klmnopqrst")}
    texts = [(prose(rng, names[lang], 120), lang) for lang in ("aa", "bb") for _ in range(8)]
    items = [prose(rng, names["aa"], 20) for _ in range(3)]
    copy = texts[2][0].split()
    copy[60] = "other"
    passage = texts[9][0][100:260]
    texts += [(texts[0][0], "aa"), (" ".join(copy), "aa")]
    texts += [(prose(rng, names["bb"], 40) + " " + passage + " " + prose(rng, names["bb"], 40), "bb"), (passage, "bb")]
    texts += [(prose(rng, names["aa"], 30) + " " + items[0] + " " + prose(rng, names["aa"], 30), "aa"), (prose(rng, names["aa"], 30) + " " + " ".join(items[1].split()[:10]), "aa")]
    texts += [("12 !!", "aa"), ("", "bb"), (None, None)]
    return [(k, t, lang, f"s{k % 3}", None if t is None else len(t)) for k, (t, lang) in enumerate(texts)], items


def in_a_language(rows):
    seen = defaultdict(lambda: defaultdict(Counter))
    for _, text, lang, _, _ in rows:
        if text is not None and lang is not None:
            b = b"\0" * ppm.ORDER + text.encode()
            for i in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    seen[lang][b[i - k : i]][b[i]] += 1

    def bits(b, contexts):
        total = 0.0
        for i in range(len(b)):
            for k in range(min(ppm.ORDER, i), -1, -1):
                below = contexts.get(b[i - k : i])
                if below:
                    t, d = sum(below.values()), len(below)
                    if b[i] in below:
                        total -= math.log2(below[b[i]] / (t + d))
                        break
                    total -= math.log2(d / (t + d))
            else:
                total += 8
        return total

    def likely(text):
        each = [bits(text.encode(), contexts) for contexts in seen.values()]
        return 1 / sum(2 ** max(-1000, min(each) - x) for x in each)

    return [r for r in rows if any(c.isalpha() for c in r[1] or "") and likely(r[1]) >= corpus_pipeline.LEAST_SCORE]


def without_copies(rows):
    sets = []
    for r in rows:
        w = r[1].split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return [r for k, r in enumerate(rows) if group[k] == k]


def without_passages(rows):
    first, out = {}, []
    for r in rows:
        for k in range(len(r[1]) - 49):
            first.setdefault(r[1][k : k + 50], r[0])
    for r in rows:
        gone = np.zeros(len(r[1]), bool)
        for k in range(len(r[1]) - 49):
            if first[r[1][k : k + 50]] < r[0]:
                gone[k : k + 50] = True
        if not gone.any():
            out.append(r)
        elif not gone.all():
            text = "".join(c for c, g in zip(r[1], gone) if not g)
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def without_items(rows, items):
    def held(words, item):
        """The planted items lie in one run, so the longest common run decides."""
        longest = max(k for i in range(len(words)) for j in range(len(item)) for k in [next((n for n in range(len(item) + 1) if words[i : i + n + 1] != item[j : j + n + 1] or i + n >= len(words) or j + n >= len(item)), 0)])
        return longest >= 5 and longest >= 0.75 * len(item)

    return [r for r in rows if not any(held(r[1].split(), item.split()) for item in items)]


def test_stages_equal_plain_python(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = [in_a_language, without_copies, without_passages, lambda rows: without_items(rows, items)]
    lost = []
    for (name, stage), plain in zip(corpus_pipeline.STAGES, steps):
        want = plain(rows)
        got = stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path))
        assert Counter(map(tuple, got.collect())) == Counter(want), name
        lost.append(sorted({r[0] for r in rows} - {r[0] for r in want}))
        rows = want
    assert lost == [[22, 23, 24], [16, 17], [19], [20]] and {r[0] for r in rows} >= {18, 21}
    pieces, places = defaultdict(list), defaultdict(list)
    fast = Encoder(vocabulary("byte_bpe_50k.json"))
    for p in corpus_pipeline.packed(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path)).collect():
        pieces[p.doc_id].append((p.start, p.length, p.ids_crc32))
        places[p.sequence_id].append((p.offset, p.length))
    assert set(pieces) == {r[0] for r in rows}
    for r in rows:
        ids, at = np.append(fast.ids([r[1]])[0], [1]).astype("<u4"), 0
        for start, length, crc in sorted(pieces[r[0]]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
