"""Url models on very long urls, the calibrated threshold and the verdicts that follow from it."""

import time
from collections import Counter

import numpy as np
import pytest

from larder.llm import url_models

PAGES = "page_id long, url string, id string, class string, score string, rule string"


def pages(spark, urls):
    """Pages with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(k, u, "a", "b", "c", "d") for k, u in enumerate(urls)], PAGES)


def test_strings_are_all_windows_of_the_padded_url(spark):
    urls = ["http://é😀x/漢", "a", "ab" * 9, "", None]
    rows = spark.createDataFrame([("allow", u) for u in urls], "class string, url string")
    got = {r.string: r.n for r in url_models.count_strings(rows).collect()}
    want = Counter()
    for u in urls:
        padded = url_models.PAD * url_models.ORDER + (u or "")
        want.update(padded[i : i + url_models.ORDER + 1] for i in range(len(u or "")))
    assert got == want


def test_very_long_urls_take_linear_time(spark):
    long = "http://net/data:" + "".join(np.random.default_rng(1).choice(list("abcdef0123/"), 1_000_000))
    df = pages(spark, ["http://example.com/de/x", "http://org/fr/y", long, long])
    begin = time.monotonic()
    got = {r.id: (r.rule, r.verdict, len(r.path)) for r in url_models.judge(df).collect()}
    assert got[2] == got[3] == ("net/", "block", len(long) - len("http://net"))
    assert time.monotonic() - begin < 90


def test_threshold_separates_best_and_stays_near_zero(spark):
    frame = lambda rows: spark.createDataFrame(rows, "class string, score double")
    rng = np.random.default_rng(2)
    scores = {"block": rng.normal(-0.6, 0.7, 300), "allow": rng.normal(0.5, 0.7, 200)}
    rows = [(c, float(x)) for c, some in scores.items() for x in some]
    found = url_models.calibrate(frame(rows))
    right = lambda t: (scores["block"] < t).mean() + (scores["allow"] >= t).mean()
    edges = np.arange(url_models.BINS) / (url_models.BINS / 8) - 4
    gains = np.array([right(t) for t in edges])
    best = edges[gains >= gains.max() - 1e-12]
    assert found == pytest.approx(best[np.argmin(np.abs(best))])
    assert url_models.calibrate(frame([("block", -3.0), ("allow", 3.0)])) == 0.0  # any place between would do
    assert url_models.calibrate(frame([("allow", 1.0)])) == url_models.calibrate(frame(rows[:0])) == 0.0


def test_verdict_follows_the_rule_then_the_threshold(spark):
    rng = np.random.default_rng(3)
    name = lambda letters: "".join(rng.choice(list(letters), 12))
    urls = [f"http://org/fr/{name('abcd')}" for _ in range(60)] + [f"http://net/{name('wxyz')}" for _ in range(60)]
    urls += [f"http://other.test/{name('abcd')}" for _ in range(10)] + [f"http://other.test/{name('wxyz')}" for _ in range(10)] + [None, ""]
    rows = {r.id: r for r in url_models.judge(pages(spark, urls)).collect()}
    assert {rows[k].verdict for k in range(60)} == {"allow"} and {rows[k].verdict for k in range(60, 120)} == {"block"}
    open_ = [rows[k] for k in range(120, 142)]
    assert [r.verdict for r in open_[:20]] == ["allow"] * 10 + ["block"] * 10
    cuts = [r.score for r in open_ if r.verdict == "allow"], [r.score for r in open_ if r.verdict == "block"]
    assert min(cuts[0]) > max(cuts[1]) and [r.score for r in open_[20:]] == [0.0, 0.0]


def test_empty_table_and_repeated_rows(spark):
    assert url_models.judge(pages(spark, ["x"]).limit(0)).count() == 0
    df = pages(spark, ["http://net/a"])
    rows = url_models.judge(df.unionAll(df).unionAll(df.selectExpr("cast(null as long) page_id", "url", "id", "class", "score", "rule"))).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.id is None)] == [0, 0, None] and {r.verdict for r in rows} == {"block"}
