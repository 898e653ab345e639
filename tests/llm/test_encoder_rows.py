"""A column's ids are those of the tokenizer, and each distinct word of a plain text is encoded once."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from larder.llm.encoding import Encoder
from larder.llm.queries import vocabulary

KINDS = ["byte_bpe_50k.json", "word_bpe_49k.json"]
BITS = ["'s", "'ll", "'re", "'ve", "'T", " ", "  ", "\n", " don't", "it's", "<|", "<|endoftext|>", " 42", "!!", "...", "ÉTÉ", " <", ""]


def some_texts():
    rng = random.Random(5)
    letters = ["aesltrmdv' .\nÉ5!", "aabdelmnrstuvzSTLRVE'''' ' !!.,<|(5790é ÉÀß÷×ªñ\n\t ́中İΣ\xa0"]
    texts = ["".join(rng.choice(rng.choice(letters) if rng.random() < 0.1 else letters[0]) if rng.random() < 0.7 else rng.choice(BITS) for _ in range(rng.randrange(30))) for _ in range(3000)]
    return [None, "", "'", "'s", "a'", "l", "'l", "l", "'r", "e", *texts]


@pytest.mark.parametrize("name", KINDS)
def test_rows_equal_tokenizer(name, monkeypatch):
    monkeypatch.setattr("larder.llm.encoding.REMEMBER", 50)
    fast, texts = Encoder(vocabulary(name)), some_texts()
    for column in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.large_string()).slice(1)):
        got = list(fast.rows(column))
        assert len(got) == len(texts) and all(g.dtype == fast.kind for g in got)
        for text, ids in zip(texts, got, strict=True):
            assert ids.tolist() == (fast.tokenizer.encode(text, add_special_tokens=False).ids if text else [])


@pytest.mark.parametrize("name", KINDS)
def test_columns_without_words(name):
    fast = Encoder(vocabulary(name))
    for texts in ([], [None], ["", None, ""], ["  \n"], [" "]):
        got = list(fast.rows(pa.array(texts, pa.string())))
        assert [g.tolist() for g in got] == [fast.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "most"), [(KINDS[0], 60 * 4 + 7), (KINDS[1], 60 + 7)])
def test_each_distinct_word_is_encoded_once(name, most):
    words = ["ka" + a + b for a in "bcdfgh" for b in "aeiouyklmn"]
    rng, fast = random.Random(1), Encoder(vocabulary(name))
    model, calls = fast.model, []
    fast.model = SimpleNamespace(tokenize=lambda word: calls.append(word) or model.tokenize(word))
    marked = lambda w: rng.choice([w, w.capitalize()]) + rng.choice(["", ",", ".", "!", "\n"])
    texts = [" ".join(marked(rng.choice(words)) for _ in range(80)) + "." for _ in range(100)]
    texts = [t.replace("\n ", "\n") for t in texts]
    got = list(fast.rows(pa.array(texts)))
    assert len(calls) == len(set(calls)) <= most  # of letters: with or without a blank and a capital; seven kinds of marks
    assert all(np.array_equal(g, fast.tokenizer.encode(t, add_special_tokens=False).ids) for g, t in zip(got, texts, strict=True))
