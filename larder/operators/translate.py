"""Dictionary translation of titles, ingredient phrases and whole records.

Dictionaries are parameters: tables or lists of (source, target) in priority order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed_values as fv
from larder.functions.structures import label_map
from larder.operators.scaling import keep_first
from larder.operators.search import match_names


class Phrases:
    """Pairs replaced in list order, whole words only, ignoring case; each pair sees the result of those before it.

    One pass of an automaton over a text finds the phrases that occur in it; only those are tried, in list order. What a
    replacement brings in is looked for again around it, so a later phrase that it completes is tried as well. The cost
    of a text is its length and what is replaced in it, not the number of phrases.
    """

    def __init__(self, pairs):
        self.pairs = [(en.lower(), re.compile(rf"\b{re.escape(en)}\b", re.I | re.A), gr) for en, gr in pairs]
        self.longest = max((len(en) for en, _, _ in self.pairs), default=0)
        self.always = [k for k, (en, _, _) in enumerate(self.pairs) if not en]  # an empty phrase stands everywhere
        self.places: dict[str, list[int]] = {}
        for k, (en, _, _) in enumerate(self.pairs):
            if en:
                self.places.setdefault(en, []).append(k)
        self.machine = None
        if self.places:
            self.machine = ahocorasick.Automaton()
            for en, own in self.places.items():
                self.machine.add_word(en, own)
            self.machine.make_automaton()

    def found(self, low: str, after: int) -> set[int]:
        """Numbers above ``after`` of the phrases that occur in a lower-case text."""
        if self.machine is None:
            return set()
        return {k for _, own in self.machine.iter(low) for k in own if k > after}

    def replace(self, text: str | None) -> str | None:
        if text is None:
            return None
        waiting = sorted(self.found(text.lower(), -1) | set(self.always))
        while waiting:
            k = heappop(waiting)
            while waiting and waiting[0] == k:
                heappop(waiting)
            en, pattern, gr = self.pairs[k]
            if en not in text.lower():
                continue
            parts, at, near = [], 0, []
            for m in pattern.finditer(text):
                parts += [text[at : m.start()], gr]
                at = m.end()
                near.append(sum(map(len, parts)) if len(near) < 8 else 0)
            if not parts:
                continue
            text = "".join(parts) + text[at:]
            # a phrase that is new to the text touches a replacement; after many of them the whole text is read again
            if len(near) < 8:
                around = (text[max(0, end - len(gr) - self.longest) : end + self.longest] for end in near)
            else:
                around = (text,)
            for piece in around:
                for new in self.found(piece.lower(), k):
                    heappush(waiting, new)
        return text


def phrase_replacer(pairs, longest_first: bool = False):
    """Column function that replaces whole words by ``pairs`` in list order, ignoring case.

    Each pair sees the result of the pairs before it. The work runs over Arrow
    batches, once per distinct text of a batch.
    """
    phrases = list(sorted(pairs, key=lambda p: -len(p[0])) if longest_first else pairs)

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Phrases(phrases)  # once a task
        for texts in batches:
            yield texts.map({t: own.replace(t) for t in texts.unique()})

    return replace


def translate_titles(titles: DataFrame, dictionary: DataFrame, title: str = "title") -> DataFrame:
    """Distinct titles with their translation: exact entry, else the first entry the title
    contains (replaced once, ignoring case), else unchanged.

    ``dictionary`` has pos, en, gr.
    """
    distinct = titles.select(F.col(title).alias("title")).distinct()
    exact = keep_first(dictionary, ["en"], [F.desc("pos")]).select(F.col("en").alias("title"), F.col("gr").alias("exact"))
    low = dictionary.select("pos", "gr", F.array(F.lower("en")).alias("terms"))
    names = distinct.select(F.lower("title").alias("name"), "title")
    # several spellings may share a lower-case form, so titles join back on it
    hits = match_names(names.select("name").distinct(), low.select("terms").distinct()).select("name", "terms")
    first = keep_first(hits.join(low, "terms"), ["name"], ["pos"])
    partial = names.join(first, "name").select("title", "gr", F.element_at("terms", 1).alias("part"))
    at = F.call_function("locate", F.col("part"), F.lower("title"))
    cut = F.concat(
        F.substring("title", 1, at - 1), F.col("gr"), F.substring("title", at + F.length("part"), F.length("title"))
    )
    j = distinct.join(exact, "title", "left").join(partial, "title", "left")
    return j.select("title", F.coalesce("exact", F.when(F.col("part").isNotNull(), cut), "title").alias("translated"))


def translate_records(records: DataFrame, dictionary: DataFrame, pairs) -> DataFrame:
    """Title, category, area and ingredients of each record; unknown labels stay as they are."""
    done = translate_titles(records, dictionary)
    label = lambda labels, c: F.coalesce(F.try_element_at(label_map(labels), F.col(c)), F.col(c)).alias(c)
    swap = phrase_replacer(pairs)
    mark = "\u0001"  # ingredients travel as one text so that a row stays a row
    swapped = F.split(swap(F.array_join("ingredients", mark)), mark)
    j = records.join(done, "title")
    kept = [c for c in records.columns if c not in ("title", "category", "area", "ingredients")]
    return j.select(
        *kept, F.col("translated").alias("title"), F.col("title").alias("title_original"),
        label(fv.MEAL_CATEGORIES, "category"), label(fv.MEAL_AREAS, "area"), swapped.alias("ingredients"),
    )
