"""Training-data operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import chat, minhash, packing, pivots, ppm, suffixes, tiling, token_files, toxicity, url_models
from larder.llm.encoding import Encoder
from larder.llm.queries import vocabulary
from larder.session import scratch_path

DOCS = "doc_id long, text string, lang string, id string, sig string, part string, g string"


def docs_frame(spark, texts, ids=None, langs=None):
    """Documents with further columns whose names clash with the operators' own."""
    ids = ids if ids is not None else list(range(len(texts)))
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "x", "y", "z", "w") for i, t, g in zip(ids, texts, langs)], DOCS).repartition(3)


def some_texts():
    rng = random.Random(3)
    names = [a + b for a in ("ba", "ke", "lo", "mi", "du") for b in ("ra", "ne", "st", "il", "o")]
    base = [" ".join(rng.choice(names) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        near.append(" ".join(w))
    shared = " ".join(rng.choice(names) for _ in range(30))
    mixed = [t + "\n" + shared + " " + base[k + 3] for k, t in enumerate(base[25:40])]
    return [*base, *near, *mixed, base[0], base[0].upper(), None, "", "  \n", "one two", "one two", "é" * 60, "é" * 70 + " ü", "a" * 200, "a" * 130]


def wordlist(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(text):
    w = wordlist(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def reach(ids, linked):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_minhash_links_equal_brute_force(spark):
    texts = some_texts()
    sets = [shingle_set(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = reach(range(len(texts)), linked)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == {i: (len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)}


def test_minhash_partners_are_cut_into_cells(monkeypatch):
    """Every pair is in one cell, with both members' rows; sets of a cell stay within twice the bound and one set."""
    monkeypatch.setattr(minhash, "CELL", 10)
    ids, n = np.arange(1, 41, dtype=np.int64), np.arange(1, 41, dtype=np.int64) % 7 + 1
    x, y = (v + 1 for v in np.triu_indices(40, 1))
    made = minhash._as_partners((pa.scalar(3), pa.scalar(5)), ids, n, x, y).to_pylist()
    assert {(r["id"], p) for r in made for p in r["partners"]} == set(zip(x.tolist(), y.tolist(), strict=True))
    assert sum(len(r["partners"]) for r in made) == len(x)
    for cell in {r["cell"] for r in made}:
        rows = [r for r in made if r["cell"] == cell]
        members = {r["id"] for r in rows}
        assert len(members) == len(rows) and all(p in members for r in rows for p in r["partners"])
        assert sum(int(n[i - 1]) for i in members) <= 2 * (10 + 7)
    empty = np.zeros(0, np.int64)
    assert minhash._as_partners((pa.scalar(3), pa.scalar(5)), ids, n, empty, empty).num_rows == 0


def test_minhash_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if k != j else "new" for k, w in enumerate(words)) for j in range(40)]
    got = minhash.near_duplicates(docs_frame(spark, texts)).collect()
    sets = [shingle_set(t) for t in texts]
    linked = [(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {r.id: r.component_id for r in got} == reach(range(40), linked)


def naive_cut(texts, ids):
    raw = [(t or "").encode() for t in texts]
    first = {}
    for i, b in sorted(zip(ids, raw)):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = Counter()
    for i, b in zip(ids, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def test_repeated_bytes_equal_brute_force(spark):
    texts = some_texts()
    ids = list(range(len(texts)))
    ids[5] = 4  # two rows with one id
    got = Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.cut_repeats(docs_frame(spark, texts, ids)).collect())
    assert got == naive_cut(texts, ids)


def test_null_id_is_left_whole(spark):
    rows = suffixes.cut_repeats(docs_frame(spark, ["x" * 80, "x" * 80, None], [1, None, None])).collect()
    assert sorted((r.id or 0, r.n_bytes, r.n_removed) for r in rows) == [(0, 0, 0), (0, 80, 0), (1, 80, 0)]


def naive_tiles(a, b, least):
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k >= least and (best is None or (-k, j, i) < best):
                    best = (-k, j, i)
        if best is None:
            return out
        k, j, i = -best[0], best[1], best[2]
        out.append((i, j, k))
        used_a |= set(range(i, i + k))
        used_b |= set(range(j, j + k))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_equal_naive_tiling(seed):
    r = np.random.default_rng(seed)
    b = r.integers(0, 6, r.integers(1, 25)).astype(np.uint64)
    cut = np.array_split(b, 3)
    a = np.concatenate([r.integers(0, 6, r.integers(0, 20)).astype(np.uint64), *[cut[k] for k in r.permutation(3)]])
    assert tiling.tile(a, b, 2) == naive_tiles(a.tolist(), b.tolist(), 2)


def test_reordered_passages_are_caught(spark):
    item = "One two three four five six. Seven eight nine ten eleven twelve! Été alpha beta gamma delta epsilon"
    texts = ["start " + item.upper() + " end", "x Seven eight nine ten eleven twelve y été alpha beta gamma delta epsilon z one two three four five six", "one two three four five six only", None, "", "tiny words"]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny words"), (None, "one")], "item_id long, text string")
    got = {(r.id, r.item_id, r.covered, r.tiles) for r in tiling.contaminated(docs_frame(spark, texts), bench).collect()}
    assert got == {(0, 7, 18, 1), (1, 7, 18, 3), (5, 10, 2, 1)}
    assert tiling.contaminated(docs_frame(spark, texts), bench.limit(0)).count() == 0


def test_ppm_code_lengths_equal_brute_force():
    rng = random.Random(1)
    counts = {"xx": Counter(), "yy": Counter()}
    for lang, letters in (("xx", "abcd "), ("yy", "abce ")):
        for _ in range(40):
            b = b"\0" * ppm.ORDER + "".join(rng.choice(letters) for _ in range(30)).encode()
            for k in range(len(b) - ppm.ORDER):
                counts[lang][int.from_bytes(b[k : k + ppm.ORDER + 1], "big")] += 1
    trees = ppm.Trees({k: np.array(sorted(v.items())) for k, v in counts.items()})
    texts = [b"abcd abce", b"", b"zz\xff", b"a", b"dddd  eeee"]
    offsets = np.cumsum([0, *map(len, texts)])
    bits = trees.lengths(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for col, lang in enumerate(("xx", "yy")):
        seen = [Counter() for _ in range(ppm.ORDER + 2)]
        for g, n in counts[lang].items():
            b = g.to_bytes(ppm.ORDER + 1, "big")
            for k in range(1, ppm.ORDER + 2):
                seen[k][b[-k:]] += n
        for row, b in enumerate(texts):
            total = 0.0
            for i in range(len(b)):
                for k in range(min(ppm.ORDER + 1, i + 1), 0, -1):
                    below = [n for s, n in seen[k].items() if s[:-1] == b[i - k + 1 : i]]
                    if below:
                        t, d, c = sum(below), len(below), seen[k][b[i - k + 1 : i + 1]]
                        if c:
                            total -= math.log2(c / (t + d))
                            break
                        total -= math.log2(d / (t + d))
                else:
                    total += 8
            assert bits[row, col] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_language_cases(spark):
    texts = ["the cat and the dog"] * 5 + ["le chat et le chien"] * 5 + [None, "", "12 !!", "the dog", "le chien"]
    langs = ["en"] * 5 + ["fr"] * 5 + [None] * 5
    docs = docs_frame(spark, texts, langs=langs)
    got = {r.id: r.lang_pred for r in ppm.identify(docs, ppm.fit(docs)).collect()}
    assert [got[k] for k in range(10, 15)] == ["und", "und", "und", "en", "fr"]
    assert {r.lang_pred for r in ppm.identify(docs, ppm.fit(docs.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizer(name):
    from tokenizers import Tokenizer

    plain, fast, rng = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name)), random.Random(2)
    parts = [" ", "  ", "\n", " \n", "The", "ß", "É", "́", "'s", "9", "12", "!", ".", ",", "\t", "\xa0", "<|endoftext|>", "Σ", "漢字", "🙂", "\0", "word", "w" * 30]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(fast.blob(text), fast.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    texts = [t * 9 if t else t for t in some_texts()]
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.pack(docs_frame(spark, texts), path, window=64, group=3000).collect()
    fast, places, pieces = Encoder(path), defaultdict(list), defaultdict(list)
    ids = [np.append(fast.ids([t])[0], [1]).astype("<u4") for t in texts]
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.id])
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.id].append((r.start, r.length))
    for spans in [*places.values(), *pieces.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {k: len(v) for k, v in enumerate(ids)}
    filled = [sum(n for _, n in v) for v in places.values()]
    assert max(filled) == 64 and sum(filled) / (64 * len(filled)) > 0.95
    assert packing.pack(docs_frame(spark, texts).limit(0), path).count() == 0


def test_sum_of_squares_rule():
    packer, r = packing.Packer(32), np.random.default_rng(0)
    for k in range(300):
        before, length = packer.level.copy(), int(r.integers(1, 32))
        costs = {}
        for fill in range(0, 32 - length + 1):
            if fill == 0 or before[fill]:
                level = before.copy()
                level[fill] -= fill > 0
                if fill + length < 32:
                    level[fill + length] += 1
                costs[fill] = int((level[1:32] ** 2).sum())
        packer.add(k, length)
        assert int((packer.level[1:32] ** 2).sum()) == min(costs.values())


def test_token_files_round_trip(spark):
    texts = some_texts()
    path, name = scratch_path(spark, "test"), vocabulary("word_bpe_49k.json")
    token_files.write_tokens(docs_frame(spark, texts), path, name)
    fast = Encoder(name)
    ids = [np.append(fast.ids([t])[0], [1]).astype("<u4") for t in texts]
    starts = np.cumsum([0, *map(len, ids)])
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, path).collect()}
    assert got == {k: (starts[k], len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids)}
    some = token_files.read_tokens(spark, path, 5, 9).collect()
    assert {r.id: list(r.ids) for r in some} == {k: ids[k].tolist() for k in range(5, 10)}
    assert "ids" not in token_files.read_lengths(spark, path).columns
    assert [r.tokens for r in token_files.read_index(spark, path).collect()] == [starts[-1]]


def test_pivot_recall_and_counts(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((150, 32))
    near = np.concatenate([b + r.standard_normal((4, 32)) * 0.08 for b in base[:60]])
    v = np.concatenate([base, near, near[:5], near[:3] * 2])
    label = [int(k) for k in r.integers(0, 2, len(v))]
    label[160] = None
    odd = [(1000, [], 0), (1001, None, 0), (1002, [0.0] * 32, 0), (1003, [float("nan")] + [1.0] * 31, 0), (1004, [None] + [1.0] * 31, 0), (1005, [1.0, 2.0], 0)]
    rows = [(k, [float(x) for x in row], lab) for k, (row, lab) in enumerate(zip(v, label))] + odd
    got = {x.id: x for x in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = np.array([sum(k != j and label[k] is not None and label[k] == label[j] and unit[k] @ unit[j] >= 0.98 for j in range(len(v))) for k in range(len(v))])
    found = np.array([got[k].n_links for k in range(len(v))])
    assert len(got) == len(rows) and (found <= links).all() and found.sum() >= 0.9 * links.sum() > 100
    assert all(got[k[0]].n_links == 0 and got[k[0]].component_id == k[0] and got[k[0]].kept for k in odd)


def test_url_rules():
    from larder.session import local_session

    spark = local_session(8)
    urls = ["http://A.example.net/en/1", "https://example.net/fr/", "http://net", "http://x.net?q=/en/", "http://example.com/de/3", "http://fr.example.org/fr/x#y", None, "none", "", "http://example.com/en/2", "ftp://EXAMPLE.org/es/a?b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_models.judge(pages).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/fr/", "net/", "block")
    assert got[2][:3] == ("net", "", None) and got[3][:3] == ("x.net", "", None)
    assert got[4] == ("example.com", "/de/3", "example.com/de/", "block") and got[5] == ("fr.example.org", "/fr/x", "org/fr/", "allow")
    assert got[6][:3] == got[7][:3] == got[8][:3] == ("", "", None) and {v[3] for v in got.values()} <= {"allow", "block"}


def test_markov_sums_to_one():
    model = url_models.Markov(Counter(["aab", "aba", "bab", "abb"]))
    for context in ("", "a", "ab", "zz"):
        assert sum(math.exp(model.log(context + c)) for c in "ab") + 65534 * math.exp(model.log(context + "q")) == pytest.approx(1)


def test_network_learns_and_empty_texts_score_zero(spark):
    rng, names = random.Random(5), [a + b for a in "bcdfg" for b in ("an", "el", "or", "ush", "im")]
    texts = [" ".join(rng.choice(names) for _ in range(60)) for _ in range(160)]
    labels = [k % 2 for k in range(160)]
    texts = [t.replace(" ", f" grotfoul{rng.choice(names)} ", 2) if y else t for t, y in zip(texts, labels)]
    params = toxicity.train(texts[:120], labels[:120])
    rows = toxicity.score(docs_frame(spark, [*texts[120:], None, "", "!!"]), params).collect()
    got = {r.id: r.score for r in rows}
    assert np.mean([(got[k] >= 0.7) == bool(labels[120 + k]) for k in range(40)]) >= 0.9
    assert [got[k] for k in (40, 41, 42)] == [0, 0, 0]
    assert toxicity.train(["a"], [1]) is None and {r.score for r in toxicity.score(docs_frame(spark, ["a"]), None).collect()} == {0.0}


def test_chat_rotation_equals_sql(spark, con):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob b", "yo"), (1, 1, "bob b", "yo"), (1, None, "system", "be kind"), (1, 2, None, None), (None, 0, "ann", "é"), (2, 0, "system", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    con.execute("CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM (VALUES " + ", ".join("(CAST({} AS BIGINT), CAST({} AS BIGINT), {}, {})".format(*["NULL" if x is None else (f"'{x}'" if isinstance(x, str) else x) for x in t]) for t in turns) + ") t(conv_id, turn, role, text)")
    want = Counter(con.execute(chat.ROTATE_SQL).fetchall())
    con.execute("DROP VIEW conversations")
    got = chat.rotate(df)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 5
    assert chat.rotate(df.limit(0)).count() == 0
