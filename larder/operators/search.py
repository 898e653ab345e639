"""Product search over whole query tables: candidates, ranking, substitutes.

The expensive step is 'name contains every term'. Product rows are first reduced
to their distinct names, each with only the cheapest rows that could still be
among the wanted k. That is exact: a row among the k cheapest of a term set is
among the k cheapest of its own name. Names and term sets are joined on a short piece
of text (a gram), each set filed under its rarest gram, and only pairs that share it are
verified. An empty set, or one of empty terms only, matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.search import expand_query, multi_word_score
from larder.functions.text import iota_canonical, substitute_norm
from larder.operators.filters import where_equal
from larder.operators.scaling import add_kept, keep_first, top_k
from larder.session import cut_lineage

GRAM = 3
ANY_TERM = 1_000  # variant number of the any-term fallback; real variants are 0, 1, 2


def grams(text: Column, n: int) -> Column:
    """Distinct pieces of ``n`` characters."""
    last = F.length(text) - (n - 1)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def match_names(names: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``names`` (distinct ``name`` plus payload) beside each set of ``terms`` they contain.

    Names and term sets are joined on the gram of the set that the fewest names hold.

    The gram comes from the longest term; shorter terms use pieces of their length.
    """
    by_length = F.sort_array(F.transform("terms", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    anchor = F.get(by_length, 0)["t"]
    piece = (
        F.when(F.length(anchor) >= GRAM, grams(anchor, GRAM))
        .when(F.length(anchor) == 2, grams(anchor, 2))
        .otherwise(grams(anchor, 1))
    )
    asked = cut_lineage(sets.select("terms", F.explode(piece).alias("gram")))
    pieces = names.select(
        "name", F.explode(F.concat(grams(F.col("name"), 3), grams(F.col("name"), 2), grams(F.col("name"), 1))).alias("gram")
    )
    # written once: counted per gram, then joined with the sets filed under each gram
    wanted = cut_lineage(pieces.join(asked.select("gram").distinct(), "gram", "left_semi"))
    frequency = wanted.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("names"))
    counted = asked.join(frequency, asked["gram"] == frequency["g"]).select("terms", "g", "names")
    filed = keep_first(counted, ["terms"], ["names", "g"]).select("g", "terms")
    pairs = filed.join(wanted, filed["g"] == wanted["gram"]).select("terms", "name")
    # kept by a generator: as a join condition this lambda over both sides fails to bind at run time
    held = add_kept(pairs, "held", F.forall("terms", lambda t: F.col("name").contains(t)), lambda ok: ok)
    return held.drop("held").join(names, "name")


def cheapest_matches(products: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The ``k`` cheapest products of each set of ``terms`` (ties by id).

    ``products`` needs id, price and match_key, the text searched in.
    """
    row = F.struct(*[F.col(c) for c in products.columns if c != "match_key"])
    names = (
        top_k(products, ["match_key"], ["price", "id"], k)
        .groupBy(F.col("match_key").alias("name"))
        .agg(F.collect_list(row).alias("rows"))  # at most k rows
    )
    hits = match_names(names, sets).select("terms", F.inline("rows"))
    return top_k(hits, ["terms"], ["price", "id"], k)


def query_variants(queries: DataFrame) -> DataFrame:
    """(qid, variant, terms): the term sets tried for each query, in order of trust.

    The words as typed come once more, one by one, as the any-term fallback of
    queries with several words.
    """
    tried = queries.select("qid", expand_query("q").alias("vs"))
    typed = F.element_at("vs", -1)
    alone = F.when(F.size(typed) > 1, F.transform(typed, lambda t: _variant(F.lit(ANY_TERM), typed, F.array(t))))
    listed = F.transform("vs", lambda ts, i: _variant(i, ts, ts))
    both = F.concat(listed, F.coalesce(alone, F.slice(listed, 1, 0)))
    return tried.where(F.size("vs") > 0).select("qid", F.inline(both))


def _variant(number: Column, terms: Column, searched: Column) -> Column:
    canonical = F.transform(searched, lambda t: iota_canonical(t))
    return F.struct(number.alias("variant"), terms.alias("terms"), canonical.alias("searched"))


def with_match_key(products: DataFrame) -> DataFrame:
    return products.withColumn("match_key", iota_canonical(F.lower("normalized_name")))


def candidates(products: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """Candidates of every query: the ``limit`` cheapest per variant, each product owned by
    its first variant; any-term matches only where no variant found a product."""
    variants = query_variants(queries)
    sets = variants.select(F.col("searched").alias("terms")).distinct()
    best = cheapest_matches(with_match_key(products), sets, limit).withColumnRenamed("terms", "searched")
    owned = keep_first(best.join(variants, "searched"), ["qid", "id"], ["variant"]).drop("searched")
    per_query = Window.partitionBy("qid")
    fallback = F.col("variant") == ANY_TERM
    place = F.row_number().over(per_query.orderBy(fallback, "price", "id"))
    return (
        owned.withColumn("__found", F.max(~fallback).over(per_query))
        .withColumn("__place", place)
        .where(~fallback | (~F.col("__found") & (F.col("__place") <= limit)))
        .drop("__found", "__place")
    )


def ranked(pool: DataFrame, floor: int = 10) -> DataFrame:
    """Score of each candidate; only scores above ``floor`` stay."""
    return add_kept(pool, "score", multi_word_score("name", F.col("terms")), lambda s: s > floor)


def dedupe_lowest_price(scored: DataFrame, k: int = 40) -> DataFrame:
    """Lowest-priced row per (query, name, store), placed where the best-ranked row of the
    pair stood; the first ``k`` per query."""
    pair = ["qid", "name", "supermarket"]
    place = F.struct((-F.col("score")).alias("s"), F.col("price").alias("p"), F.col("id").alias("i"))
    cheapest = F.struct(F.col("price").alias("p"), place.alias("r"))
    kept = scored.groupBy(*pair).agg(F.min(place).alias("place"), F.min_by(F.struct("id", "price"), cheapest).alias("row"))
    out = top_k(kept, ["qid"], ["place"], k, rank="rank")
    return out.select("qid", "rank", "row.id", "name", "supermarket", "row.price")


def search(products: DataFrame, queries: DataFrame, store: str | None = None, k: int = 40) -> DataFrame:
    """Ranked product search for a whole table of queries.

    A text asked many times is searched once, under one of its ids, and its ``k`` rows
    are handed to all who asked.
    """
    pool = where_equal(products, supermarket=store)
    asked = queries.groupBy("q").agg(F.min("qid").alias("qid"))
    found = dedupe_lowest_price(ranked(candidates(pool, asked)), k).withColumnRenamed("qid", "same_as")
    askers = queries.join(asked.withColumnRenamed("qid", "same_as"), "q").select("qid", "same_as")
    return found.join(askers, "same_as").select("qid", "rank", "id", "name", "supermarket", "price")


def substitutes(products: DataFrame, pool: int = 30, considered: int = 6, shown: int = 3) -> DataFrame:
    """Up to three alternatives of every product: same first word, another store or cheaper.

    The pool of a word is its 30 cheapest products, an array of fixed size, so a
    first word shared by a third of all products costs one small lookup per row.
    """
    keyed = products.withColumn("word", substitute_norm("name"))
    words = keyed.select("word").where(F.length("word") > 0).distinct()
    sets = words.select(F.array("word").alias("terms"))
    item = F.struct("price", "id", "name", "supermarket")
    pools = (
        cheapest_matches(products.withColumn("match_key", F.lower("normalized_name")), sets, pool)
        .groupBy(F.element_at("terms", 1).alias("word"))
        .agg(F.sort_array(F.collect_list(item)).alias("pool"))
    )

    def allowed(p):
        other_store = F.lower(p["supermarket"]) != F.lower(F.col("supermarket"))
        return (p["price"] > 0) & (other_store | (p["price"] < F.col("price")))

    chosen = F.slice(F.slice(F.filter("pool", allowed), 1, considered), 1, shown)
    return keyed.join(pools, "word").select("id", F.posexplode(chosen).alias("pos", "alt")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("alt.id").alias("alt_id"),
        F.col("alt.supermarket").alias("alt_store"), F.col("alt.price").alias("alt_price"),
    )


def top_offers(offers: DataFrame, k: int = 20, numeric: bool = False) -> DataFrame:
    """Active offers by discount and date. The discount sorts as text unless ``numeric``."""
    rate = F.regexp_extract("discount_percent", "(\\d+)", 1).try_cast("int") if numeric else F.col("discount_percent")
    return offers.where("is_on_sale AND price > 0").orderBy(
        rate.desc(), F.desc("date_scraped"), F.desc("pos")
    ).limit(min(50, k))
