"""Phrase replacement by the automaton against the plain fold over all pairs."""

import random
import re
import time

import pytest

from larder.operators import translate


def fold(pairs, text):
    for en, gr in pairs:
        if text is not None and en.lower() in text.lower():
            text = re.sub(rf"\b{re.escape(en)}\b", lambda _: gr, text, flags=re.I | re.A)  # noqa: B023
    return text


def test_equal_to_the_fold_on_random_lists():
    rng = random.Random(1)
    words = ["a", "b", "ab", "milk", "coconut", "oil", "é", "Ü", "x-y", "γάλα", "(1)", "milky", "İ"]
    for _ in range(1500):
        some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
        pairs = [(some(2), rng.choice([some(2), "", "milk", "γάλα"])) for _ in range(rng.randint(0, 12))]
        text = rng.choice([" ", ", ", ""]).join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(words, k=rng.randint(0, 25)))
        assert translate.Phrases(pairs).replace(text) == fold(pairs, text), (pairs, text)


@pytest.mark.parametrize(
    "pairs, text, want",
    [
        ([("milk", "cream"), ("cream cheese", "feta")], "Milk cheese", "feta"),  # brought in by an earlier replacement
        ([("cream cheese", "feta"), ("milk", "cream")], "milk cheese", "cream cheese"),  # a later one brings it in too late
        ([("coconut milk", "x"), ("milk", "y")], "coconut milk and milk", "x and y"),
        ([("a", "b"), ("b", "a")], "a b a", "a a a"),
        ([("oil", "$1 \\g<0>")], "oil!", "$1 \\g<0>!"),
        ([], "as it is", "as it is"),
        ([("a", "b")], "", ""),
        ([("a", "b")], None, None),
    ],
)
def test_order_of_the_list_holds(pairs, text, want):
    assert translate.Phrases(pairs).replace(text) == want == fold(pairs, text)


def test_many_hits_are_read_again_as_a_whole():
    pairs = [("milk", "cream"), ("cream cream", "butter"), ("butter", "oil")]
    text = "milk " * 41 + "x"
    assert translate.Phrases(pairs).replace(text) == fold(pairs, text)


def test_cost_does_not_grow_with_the_list():
    """20,000 phrases that do not occur cost a text no more than twenty."""
    text = "two cups of milk and some sugar " * 20

    def seconds(n):
        own = translate.Phrases([(f"phrase number {i}", "x") for i in range(n)] + [("milk", "γάλα")])
        own.replace(text)
        start = time.perf_counter()
        for _ in range(200):
            own.replace(text)
        return time.perf_counter() - start

    assert seconds(20_000) < 10 * seconds(20) + 0.05


def test_column_function(spark):
    pairs = [("milk", "γάλα"), ("brown sugar", "ζάχαρη"), ("sugar", "s")]
    texts = ["Milk and brown sugar", "milkshake", None, "", "SUGAR", "Milk and brown sugar"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").repartition(3)
    got = {r.i: r.y for r in frame.select("i", translate.phrase_replacer(pairs)("x").alias("y")).collect()}
    assert got == {i: fold(pairs, t) for i, t in enumerate(texts)}
    longest = {r.i: r.y for r in frame.select("i", translate.phrase_replacer(pairs[::-1], longest_first=True)("x").alias("y")).collect()}
    assert longest[0] == "γάλα and ζάχαρη"
