"""Text expressions: normalisation, cleaning, recipe lines, urls.

All are native expressions. ``\\b`` is avoided on purpose: Java treats Greek
letters as word characters only in some modes, so boundaries are spelt out.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import fixed_values as fv

BLANKS = " \t\n\r\f\v ﻿"
MARKS = "".join(chr(i) for i in range(0x300, 0x370))


def _accent_table() -> tuple[str, str]:
    """Every BMP letter that decomposes to one plain letter plus marks U+0300-036F."""
    accented, plain = [], []
    for code in range(0xC0, 0x2FFF):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(p in MARKS for p in parts[1:]):
            accented.append(chr(code))
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x) -> Column:
    return F.trim(_c(x), F.lit(BLANKS))


def strip_accents(x) -> Column:
    # marks listed after the letters have no counterpart, so translate drops them; plain ASCII needs no look at the table
    x = _c(x)
    return F.when(x.rlike("[^\\x00-\\x7F]"), F.translate(x, ACCENTED + MARKS, PLAIN)).otherwise(x)


def norm_text(x) -> Column:
    """Lower case, accents removed, trimmed."""
    return js_trim(strip_accents(F.lower(_c(x))))


VOWELS = ("αάΑΆεέΕΈηήΗΉιίΙΊϊΐοόΟΌυύΥΎϋΰωώΩΏ", "ααααεεεεηηηηιιιιιιοοοουυυυυυωωωω")


def substitute_norm(x) -> Column:
    """First word of a name with Greek vowels folded."""
    return F.split_part(js_trim(F.translate(F.lower(_c(x)), *VOWELS)), F.lit(" "), F.lit(1))


def iota_canonical(x) -> Column:
    """η and υ sound like ι; fold them so that spellings compare equal."""
    return F.translate(_c(x), "ηυ", "ιι")


def greeklish_to_greek(x) -> Column:
    c = _c(x)
    out = F.lower(c)
    for pair, greek in fv.GREEKLISH_PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(greek))
    out = F.translate(out, *fv.GREEKLISH_LETTERS)
    return F.when(~c.rlike("[α-ωΑ-Ω]"), out)


def words(x, longer_than: int) -> Column:
    return F.filter(F.split(_c(x), "\\s+"), lambda w: F.length(w) > longer_than)


def strip_quantity(x) -> Column:
    units = "|".join(fv.QUANTITY_UNITS)
    return js_trim(F.regexp_replace(_c(x), f"(?iu)^\\s*\\d+[\\d.,]*\\s*({units})\\s*", ""))


def clean_ingredient_name(x) -> Column:
    no_grams = F.regexp_replace(_c(x), "(?iu)^\\d+[γg]ρ?\\s*", "")
    return F.lower(js_trim(F.substring_index(no_grams, "(", 1)))


def extract_grams(x) -> Column:
    return F.regexp_extract(_c(x), "(?iu)(\\d+)\\s*[γg]ρ?", 1).try_cast("int")


def clean_html(x) -> Column:
    """Tags to blanks, common entities decoded, the others dropped, blanks collapsed."""
    out = F.regexp_replace(_c(x), "<[^>]*>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "&#\\d+;|&[a-z]+;", "")
    return js_trim(F.regexp_replace(out, "\\s{2,}", " "))


UNTIDY = "[<&]|\\s{2}|^[\\s ﻿]|[\\s ﻿]$"


def clean_line(x: Column) -> Column:
    """clean_html for a line held in a variable: most lines need nothing done."""
    return F.when(x.rlike(UNTIDY), clean_html(x)).otherwise(x)


def clean_text(x, fallback: str = "") -> Column:
    collapsed = F.regexp_replace(js_trim(x), "\\s+", " ")
    return F.coalesce(F.nullif(collapsed, F.lit("")), F.lit(fallback))


def norm_line(x) -> Column:
    return norm_text(clean_html(x))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain reference inside an
    array lambda would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


ALL_CAPS = "^(?=(?:[^A-ZΑ-Ω]*[A-ZΑ-Ω]){6})[^a-zα-ω]*$"  # six capitals or more, no small letter
NOISE = "^$|^(bio\\s+προτεινομενα|απο\\s+\\d+)|" + "|".join(fv.NOISE_PHRASES)
NOISE_RAW = "€|\\$\\d|(?i:gymbeam)"
WORD_END = "([^\\p{L}\\p{N}_]|$)"
SECTION = (
    f"^για\\s+(τη|την|το|τον){WORD_END}|θα\\s+χρειαστουμε[\\s:.]*$"
    f"|^(υλικα|συστατικα|εκτελεση|οδηγιες|παρασκευη|σερβιρισμα){WORD_END}"
)


def is_noise_line(x) -> Column:
    """Empty, marketing, price or all-capitals line."""
    c = _c(x)
    return norm_line(c).rlike(NOISE) | c.rlike(NOISE_RAW) | clean_html(c).rlike(ALL_CAPS)


def is_section_line(x) -> Column:
    """Heading of an ingredient or instruction section."""
    return norm_line(x).rlike(SECTION)


def _first_of_each_key(rows: Column) -> Column:
    """Texts ``v`` of structs (k, i, v), one per key, in the order of ``i``.

    Sorts by (key, position), keeps the first of each key, and sorts back, so a long
    text costs n log n.
    """

    def firsts(ordered):
        new_key = lambda s, j: (j == 0) | (F.get(ordered, j - 1)["k"] != s["k"])
        kept = F.transform(F.filter(ordered, new_key), lambda s: F.struct(s["i"].alias("i"), s["v"].alias("v")))
        return F.transform(F.sort_array(kept), lambda s: s["v"])

    return let(F.sort_array(rows), firsts)


def dedupe_lines(lines) -> Column:
    """Drop blank and repeated lines by their normalised form, first kept, order kept."""
    keyed = F.transform(
        _c(lines), lambda x, i: F.struct(norm_text(clean_line(x)).alias("k"), i.alias("i"), x.alias("v"))
    )
    return _first_of_each_key(F.filter(keyed, lambda s: s["k"] != ""))


def strip_bullet(x) -> Column:
    out = F.regexp_replace(_c(x), "^[•·▪●]\\s*", "")
    out = F.regexp_replace(out, "^[-–—]\\s*", "")
    return F.regexp_replace(out, "^\\d+[.)]\\s*", "")


def strip_step_prefix(x) -> Column:
    """Drop the step number and 'FITNESS ΣΥΝΤΑΓΗ:' style labels."""
    out = F.regexp_replace(_c(x), "^\\d+[.)]\\s*", "")
    return js_trim(F.regexp_replace(out, "(?iu)^(FITNESS\\s+)?ΣΥΝΤΑΓ[ΗΉ]\\s*(FITNESS\\s*)?:\\s*", ""))


def sanitize_lines(lines, instructions: bool = False) -> Column:
    """Lines without bullets, noise, headings, odd lengths and repeats.

    Each line is cleaned and normalised once; the tests share the results.
    """
    length_ok = (lambda v: F.length(v) >= 10) if instructions else (lambda v: F.length(v).between(2, 140))

    def judge(v, i):
        def with_clean(c):
            def with_key(k):
                keep = (v != "") & length_ok(v) & ~v.rlike(NOISE_RAW) & ~c.rlike(ALL_CAPS) & ~k.rlike(NOISE) & ~k.rlike(SECTION)
                return F.struct(keep.alias("keep"), k.alias("k"), i.alias("i"), v.alias("v"))

            return let(norm_text(c), with_key)

        return let(clean_line(v), with_clean)

    plain = F.transform(_c(lines), lambda x: strip_bullet(clean_line(x)))
    judged = F.filter(F.transform(plain, judge), lambda s: s["keep"] & (s["k"] != ""))
    return _first_of_each_key(
        F.transform(judged, lambda s: F.struct(s["k"].alias("k"), s["i"].alias("i"), s["v"].alias("v")))
    )


SENTENCE_BREAK = "(?<=[.!?])\\s+(?=[A-ZΑ-Ω])"


def split_instructions(x) -> Column:
    """Paragraphs if there are several, else sentences that start with a capital."""
    text = js_trim(x)
    tidy = lambda parts: F.filter(F.transform(parts, clean_html), lambda s: s != "")
    paragraphs = tidy(F.split(text, "\\r?\\n+"))
    return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(tidy(F.split(clean_html(text), SENTENCE_BREAK)))


def section_split(x) -> Column:
    """struct(ingredients, instructions): text after the first known ingredient marker,
    up to the nearest instruction marker; both empty when no marker is found."""
    c = _c(x)
    starts = [F.when(F.instr(c, m) > 0, F.instr(c, m) + len(m)) for m in fv.INGREDIENT_MARKERS]
    start = F.coalesce(*starts)
    ends = []
    for m in fv.INSTRUCTION_MARKERS:
        at = F.call_function("locate", F.lit(m), c, start)
        ends.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(-len(m)).alias("len"))))
    nearest = F.least(*ends)
    end = F.coalesce(nearest["at"], F.length(c) + 1)
    head = F.when(start.isNotNull(), F.substring(c, start, end - start)).otherwise("")
    tail = F.when(
        start.isNotNull() & nearest.isNotNull(),
        js_trim(F.substring(c, nearest["at"] - nearest["len"], F.length(c))),
    ).otherwise("")
    return F.struct(head.alias("ingredients"), tail.alias("instructions"))


def sentence_chunks(x, limit: int = 450) -> Column:
    """Sentences packed greedily into chunks of at most ``limit`` characters."""
    # cut between an end mark and the next text: linear, where matching whole sentences
    # would rescan a long tail that has no end mark from every position
    marks = [".", "!", "?", "\n"]
    pieces = F.split(_c(x), "(?<=[.!?\\n])(?=[^.!?\\n])", -1)
    whole = lambda p: F.right(p, F.lit(1)).isin(marks) & ~F.left(p, F.lit(1)).isin(marks)
    sentences = let(F.filter(pieces, whole), lambda ss: F.when(F.size(ss) > 0, ss).otherwise(F.array(_c(x))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, s):
        over = F.length(acc["cur"]) + F.length(s) > limit
        done = F.when(over & (acc["cur"] != ""), F.array_append(acc["done"], js_trim(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(over, s).otherwise(F.concat(acc["cur"], s)).alias("cur"))

    def finish(acc):
        last = js_trim(acc["cur"])
        return F.when(last != "", F.array_append(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(sentences, start, step, finish)


def strip_packaging_words(x) -> Column:
    return js_trim(F.regexp_replace(_c(x), "(?iu)το τεμάχιο|το τεμαχιο|συσκευασία|συσκευασια", ""))


def url_canonical(x) -> Column:
    return F.substring_index(F.substring_index(_c(x), "#", 1), "?", 1)


def url_to_store(x, domains=None) -> Column:
    """struct(store, id) of the first domain found in the url, else null."""
    c = _c(x)
    hits = [
        F.when(c.contains(domain), F.struct(F.lit(label).alias("store"), F.lit(sid).alias("id")))
        for domain, label, sid in (domains or fv.STORE_DOMAINS)
    ]
    return F.coalesce(*hits)


def strip_leading_zeros(x) -> Column:
    return F.ltrim(_c(x), F.lit("0"))


def split_keywords(x) -> Column:
    return F.filter(F.transform(F.split(_c(x), ","), js_trim), lambda w: w != "")


def parse_key_list(x, limit: int = 25) -> Column:
    keys = F.filter(F.transform(F.split(_c(x), ","), lambda w: F.upper(js_trim(w))), lambda w: w != "")
    return F.slice(keys, 1, limit)


def title_from_page(x) -> Column:
    """Page title without its trailing ' - site' part."""
    return js_trim(F.regexp_replace(_c(x), "\\s*[–—|-].*$", ""))


def as_text(array) -> Column:
    return F.concat_ws("|", _c(array))
