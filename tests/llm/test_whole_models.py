"""Models keep all strings of their class, however many there are."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import ppm, url_models


def test_url_scores_are_of_all_strings(spark):
    rng = random.Random(4)
    letters = "".join(map(chr, range(0x61, 0x7B))) + "".join(map(chr, range(0x3B1, 0x3CA)))
    urls = ["http://a.net/" + "".join(rng.choices(letters, k=40)) for _ in range(5000)]
    urls += ["http://example.net/en/" + "".join(rng.choices(letters[:9], k=12)) for _ in range(50)] + ["http://new.info/" + urls[0][13:30], "", None, urls[0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    rows = url_models.judge(pages).join(pages.select("page_id", "url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("aside")), F.col("id") == F.col("page_id")).collect()
    counts = {"allow": Counter(), "block": Counter()}
    pad = url_models.PAD * url_models.ORDER
    strings = lambda url: [(pad + url)[i : i + url_models.ORDER + 1] for i in range(len(url))]
    for r in rows:
        if r.rule and not r.aside:
            counts[r.verdict].update(strings(r.url))
    assert len(counts["block"]) > 100_000 and len(rows) == len(urls)
    models = {c: url_models.Markov(n) for c, n in counts.items()}
    for r in rows:
        want = [models["allow"].log(s) - models["block"].log(s) for s in strings(r.url)] if r.url else [0]
        assert r.score == pytest.approx(sum(want) / len(want), abs=1e-9)


def test_language_model_has_all_strings(spark):
    rng, want = random.Random(8), Counter()
    texts = [bytes(rng.choices(range(0x61, 0x7B), k=50)).decode() for _ in range(2000)]
    for t in texts:
        b = b"\0" * ppm.ORDER + t.encode()
        want.update(int.from_bytes(b[i : i + ppm.ORDER + 1], "big") for i in range(len(t)))
    docs = spark.createDataFrame([("xx", t) for t in texts] + [("yy", "other")], "lang string, text string").repartition(4)
    model = ppm.fit(docs)
    assert len(want) > 40_000 and dict(model["xx"].tolist()) == want and len(model["yy"]) == 5
