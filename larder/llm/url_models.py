"""URL filter by the ratio of two character language models.

Stated rules (host, path prefix) decide first; the longest that fits wins. The urls they decide also teach the method:
for accepted and for rejected urls, the counts of all strings of one to ``ORDER + 1`` characters give a variable-order
Markov model with Witten-Bell smoothing, down to equal characters. The model is a table and is never gathered: the
distinct strings of the urls to judge are joined with it one length at a time, where a row meets at most as many others
as there are characters, and their values go back to blocks of urls, whose distinct strings are what is sent.
A url's score is the difference of its two log-likelihoods for each character. The threshold is calibrated on a fifth of the decided urls, chosen by a
hash of the url and kept out of the counts: the score that best separates the two classes there (ties: nearest 0). A
url at or above the threshold is allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. Defined cases: a null url or one without ``://`` has an empty host and path; a null or empty url scores
0; without both classes every score and the threshold are 0; repeated rows are judged each; a null id is kept; other
columns are ignored; an empty table gives an empty result. Time grows with a url's length, not with its square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import let
from larder.llm.common import plain
from larder.session import cut_lineage

ORDER = 4
#: Urls that are scored together: two to this power, neighbours in the table.
BLOCK_BITS = 10
CLASSES = ("allow", "block")
FLOOR = math.log(1 / 65536)
PAD = "\x02"
#: Bins of the calibration histogram, over scores from -4 to 4.
BINS = 4096
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits host (or a subdomain of it) and path, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _strings(url: Column) -> Column:
    """The ``ORDER + 1`` characters that end at each character of a padded url; split once, so linear in its length."""
    padded = F.split(F.concat(F.lit(PAD * ORDER), url), "")

    def joined(characters):
        starts = F.sequence(F.lit(0), F.size(characters) - (ORDER + 1))
        return F.transform(starts, lambda i: F.concat(*(F.get(characters, i + k) for k in range(ORDER + 1))))

    return let(padded, joined)


def count_strings(urls: DataFrame) -> DataFrame:
    """(class, string, n) of all (class, url)."""
    strings = urls.where(F.length("url") > 0).select("class", F.explode(_strings(F.col("url"))).alias("string"))
    return strings.groupBy("class", "string").agg(F.count("*").alias("n"))


class Markov:
    """Witten-Bell smoothed model of one class."""

    def __init__(self, counts: dict[str, int]):
        self.count: dict[str, int] = {}
        for string, n in counts.items():
            for k in range(len(string)):
                part = string[k:]
                self.count[part] = self.count.get(part, 0) + n
        self.total: dict[str, int] = {}
        self.kinds: dict[str, int] = {}
        for part, n in self.count.items():
            self.total[part[:-1]] = self.total.get(part[:-1], 0) + n
            self.kinds[part[:-1]] = self.kinds.get(part[:-1], 0) + 1

    def log(self, string: str) -> float:
        """Log probability of the last character after the ones before it."""
        p = math.exp(FLOOR)
        for k in range(len(string) - 1, -1, -1):
            context = string[k:-1]
            kinds = self.kinds.get(context)
            if not kinds:
                break
            p = (self.count.get(string[k:], 0) + kinds * p) / (self.total[context] + kinds)
        return math.log(p)


def fit(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model of (class, url): (part, n_allow, n_block), the counts of every string of one to ``ORDER + 1`` characters,
    and (context, total_allow, kinds_allow, ...), how often and by how many characters each context is followed."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substring("string", k, F.lit(ORDER + 1)))
    counts = count_strings(urls).select("class", F.explode(ends).alias("part"), "n").groupBy("part").agg(
        *(F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"n_{c}") for c in CLASSES))
    parts = cut_lineage(counts)
    followed = parts.groupBy(_context().alias("context")).agg(
        *(F.sum(f"n_{c}").alias(f"total_{c}") for c in CLASSES), *(F.count_if(F.col(f"n_{c}") > 0).alias(f"kinds_{c}") for c in CLASSES))
    return parts, cut_lineage(followed)


def _context() -> Column:
    return F.substring("part", F.lit(1), F.length("part") - 1)


def differences(asked: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(string, difference of log probabilities of its last character) of the distinct strings of ``asked``."""
    parts, followed = model
    below = None
    for k in range(1, ORDER + 2):
        ends = asked.select(F.right("string", F.lit(k)).alias("part")).distinct()
        rows = ends.select("part", _context().alias("context"), F.right("part", F.lit(k - 1)).alias("end"))
        rows = rows.join(parts.where(F.length("part") == k), "part", "left").join(followed.where(F.length("context") == k - 1), "context", "left")
        rows = rows.join(below, "end", "left") if below is not None else rows.select("*", *(F.lit(math.exp(FLOOR)).alias(f"below_{c}") for c in CLASSES))
        p = []
        for c in CLASSES:
            kinds, shorter = F.coalesce(f"kinds_{c}", F.lit(0)), F.col(f"below_{c}")
            own = F.try_divide(F.coalesce(f"n_{c}", F.lit(0)) + kinds * shorter, F.col(f"total_{c}") + kinds)
            p.append(F.when(kinds > 0, own).otherwise(shorter).alias(f"below_{c}"))
        below = rows.select(F.col("part").alias("end"), *p)
    return below.select(F.col("end").alias("string"), (F.log("below_allow") - F.log("below_block")).alias("difference"))


def ratio(rows: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(all columns of ``rows``, score); the text column is ``url``."""
    both = model[0].agg(*(F.coalesce(F.max(f"n_{c}"), F.lit(0)).alias(c) for c in CLASSES)).first()
    if not (both.allow and both.block):
        return rows.withColumn("score", F.lit(0.0))
    kept = cut_lineage(rows.withColumn("__block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
    strings = F.explode(F.array_distinct(_strings(F.col("url"))))
    asked = cut_lineage(kept.where(F.length("url") > 0).select("__block", strings.alias("string")).distinct())
    found = asked.join(differences(asked.select("string").distinct(), model), "string")
    names = [c for c in kept.columns if c != "__block"]

    def each(urls, strings):
        known = dict(zip(strings.column("string").to_pylist(), strings.column("difference").to_pylist()))
        scores = []
        for url in urls.column("url").to_pylist():
            if not url:
                scores.append(0.0)
                continue
            padded, total = PAD * ORDER + url, 0.0
            for i in range(len(url)):
                total += known[padded[i : i + ORDER + 1]]
            scores.append(total / len(url))
        return urls.select(names).append_column("score", pa.array(scores, pa.float64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return kept.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(each, f"{schema}, score double")


def calibrate(scored: DataFrame) -> float:
    """Threshold that separates the classes best, from a histogram of (class, score)."""
    bin_ = F.least(F.greatest(F.floor((F.col("score") + 4) * (BINS / 8)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counted = np.zeros((2, BINS))
    for label, b, n in scored.groupBy("class", bin_.alias("bin")).count().collect():  # at most two rows a bin
        counted[int(label == "allow"), b] = n
    if not counted.sum(1).all():
        return 0.0
    share = counted / counted.sum(1, keepdims=True)
    edges = np.arange(BINS) / (BINS / 8) - 4
    gain = np.cumsum(share[0]) - share[0] + (1 - (np.cumsum(share[1]) - share[1]))  # rejected below + accepted from here on
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row."""
    urls = plain(pages, id_col, url_col).toDF("id", "url")
    parsed = urls.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"))
    verdict = F.lit(None).cast("string")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    ruled = ruled.withColumn("class", verdict)
    aside = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    model = fit(ruled.where("rule is not null").where(~aside).select("class", "url"))
    scored = cut_lineage(ratio(ruled, model))
    threshold = calibrate(scored.where("rule is not null").where(aside).select("class", "score"))
    by_method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("id", "host", "path", "rule", F.coalesce("class", by_method).alias("verdict"), "score")
