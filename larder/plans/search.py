"""Product search: candidates, scores, ranking, substitutes, offers, full text."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import search as fs
from larder.functions.dates import epoch_micros
from larder.functions.text import as_text, greeklish_to_greek, iota_canonical, norm_text
from larder.operators import fulltext, search
from larder.operators.scaling import add_kept, keep_first, top_k
from larder.plans.registry import query
from larder.sources import tables

GREEKLISH = "lower(trim(q))"
for _pair, _greek in (("th", "θ"), ("ou", "ου"), ("ks", "ξ"), ("ps", "ψ"), ("ch", "χ"), ("ph", "φ"), ("gh", "γ"),
                      ("ai", "αι"), ("ei", "ει"), ("oi", "οι"), ("au", "αυ"), ("eu", "ευ")):
    GREEKLISH = f"replace({GREEKLISH}, '{_pair}', '{_greek}')"
GREEKLISH = f"translate({GREEKLISH}, 'abgdezhiklmnxoprstufywvcq', 'αβγδεζηικλμνξοπρστυφυωβκκ')"
TERMS = "[t FOR t IN string_split({0}, ' ') IF length(t) > 1]"
# variants of the fixture queries: none is a dictionary word, all are Latin, so greeklish comes first
VARIANTS = f"""variants AS (SELECT qid, 0 AS variant, {TERMS.format(GREEKLISH)} AS terms FROM v_queries
    UNION ALL SELECT qid, 1, {TERMS.format('lower(trim(q))')} FROM v_queries)"""
CANDIDATES = VARIANTS + """,
  hits AS (SELECT v.qid, v.variant, v.terms, p.*, row_number() OVER (PARTITION BY v.qid, v.variant ORDER BY p.price, p.id) AS rn
    FROM variants v JOIN v_products p ON len(v.terms) > 0
     AND len([t FOR t IN v.terms IF contains(translate(p.normalized_name, 'ηυ', 'ιι'), translate(t, 'ηυ', 'ιι'))]) = len(v.terms)),
  found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY variant) AS own FROM hits WHERE rn <= 100) WHERE own = 1)"""
FALLBACK = CANDIDATES + """,
  missed AS (SELECT qid, terms FROM variants WHERE variant = 1 AND len(terms) > 1 AND qid NOT IN (SELECT qid FROM found)),
  extra AS (SELECT m.qid, 1000 AS variant, m.terms, p.*, row_number() OVER (PARTITION BY m.qid ORDER BY p.price, p.id) AS rn
    FROM missed m JOIN v_products p ON len([t FOR t IN m.terms IF contains(p.normalized_name, t)]) > 0),
  pool AS (SELECT qid, variant, terms, id, name, supermarket, price FROM found
    UNION ALL SELECT qid, variant, terms, id, name, supermarket, price FROM extra WHERE rn <= 100)"""
TERM_SCORE = """CASE WHEN name = t THEN 100 WHEN starts_with(name, t || ' ') THEN 90
    WHEN contains(' ' || name || ' ', ' ' || t || ' ') THEN 80 WHEN contains(' ' || name, ' ' || t) THEN 60
    WHEN contains(name, t) THEN 20 ELSE 0 END"""
# the fixture names hold no pet or flavour words, so no penalty applies
SCORED = FALLBACK + f""",
  per_term AS (SELECT *, [{TERM_SCORE} FOR t IN terms] AS ss FROM pool),
  scored AS (SELECT qid, variant, terms, id, name, supermarket, price,
    CASE WHEN list_min(ss) = 0 THEN 0 ELSE CAST(list_sum(ss) AS BIGINT)
      + CASE WHEN regexp_matches(name, array_to_string(terms, '.*')) THEN 10 ELSE 0 END
      + CASE WHEN starts_with(name, terms[1]) THEN 20 ELSE 0 END END AS score FROM per_term),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, price, id) AS place FROM scored WHERE score > 10)"""
V = ("v_queries", "v_products")


def parts(spark, d):
    return tables.products(spark, d), tables.search_queries(spark)


@query("join_query_product", f"WITH {CANDIDATES} SELECT qid, variant, id, price FROM found", V)
def join_query_product(spark, d):
    c = search.candidates(*parts(spark, d))
    return c.where(F.col("variant") < search.ANY_TERM).select("qid", "variant", "id", "price")


@query("filter_any_term", f"WITH {FALLBACK} SELECT qid, id, price FROM extra WHERE rn <= 100", V)
def filter_any_term(spark, d):
    c = search.candidates(*parts(spark, d))
    return c.where(F.col("variant") == search.ANY_TERM).select("qid", "id", "price")


@query("union_first_seen", f"WITH {FALLBACK} SELECT qid, id, variant FROM pool", V)
def union_first_seen(spark, d):
    return search.candidates(*parts(spark, d)).select("qid", "id", "variant")


@query("multi_word_score", f"WITH {SCORED} SELECT qid, id, score FROM scored", V)
def multi_word_score(spark, d):
    c = search.candidates(*parts(spark, d))
    return c.select("qid", "id", fs.multi_word_score("name", F.col("terms")).alias("score"))


@query("topk_search_rank", f"WITH {SCORED} SELECT qid, place AS rank, id, score, price FROM ranked WHERE place <= 40", V)
def topk_search_rank(spark, d):
    scored = search.ranked(search.candidates(*parts(spark, d)))
    return top_k(scored, ["qid"], [F.desc("score"), "price", "id"], 40, rank="rank").select("qid", "rank", "id", "score", "price")


@query("win_dedupe_lowest_price", f"""WITH {SCORED},
  kept AS (SELECT qid, name, supermarket, min(place) AS first_place, min_by(id, (price, place)) AS id, min(price) AS price FROM ranked GROUP BY 1, 2, 3)
  SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY first_place) AS rank, id, name, supermarket, price FROM kept) t WHERE rank <= 40""", V)
def win_dedupe_lowest_price(spark, d):
    return search.search(*parts(spark, d))


@query("match_score", f"SELECT n.p_name AS name, t, CAST(count(*) AS BIGINT) AS n_products, CAST(max({TERM_SCORE.replace('name', 'n.p_name')}) AS BIGINT) AS score "
       "FROM part n, (VALUES ('red'), ('ring'), ('gi'), ('red ring'), ('old'), ('widget')) q(t) GROUP BY 1, 2")
def match_score(spark, d):
    """Term scores of each distinct name; a name is scored once however many products bear it."""
    terms = [w for w in ("red", "ring", "gi", "red ring", "old", "widget")]
    names = tables.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n_products"))
    return names.select("name", "n_products", F.explode(F.lit(terms)).alias("t")).withColumn("score", fs.match_score("name", "t"))


PET = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'cat food ' || p_name WHEN 1 THEN p_name || ' αρωμα ring' ELSE p_name END AS name FROM part"""


@query("is_irrelevant", f"""SELECT id, (name LIKE 'cat food %') OR (contains(name, 'αρωμα') AND NOT contains(' ' || split_part(name, ' αρωμα', 1), ' ring')) AS irrelevant
    FROM ({PET}) t""")
def is_irrelevant(spark, d):
    k = F.col("p_partkey") % 4
    named = tables.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(k == 0, F.concat(F.lit("cat food "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" αρωμα ring")))
        .otherwise(F.col("p_name")).alias("name"))
    return named.select("id", fs.is_irrelevant("name", F.lit("ring")).alias("irrelevant"))


@query("expand_query", """
    WITH names AS (SELECT DISTINCT p_name AS q FROM part)
    SELECT q, 'milk|γαλα' AS fixed_case, array_to_string([t FOR t IN string_split(""" + GREEKLISH + """, ' ') IF length(t) > 1], '|') AS first_variant,
           array_to_string([t FOR t IN string_split(lower(q), ' ') IF length(t) > 1], '|') AS last_variant FROM names""")
def expand_query(spark, d):
    names = tables.table(spark, d, "part").select(F.col("p_name").alias("q")).distinct()
    v = fs.expand_query("q")
    milk = F.get(F.get(fs.expand_query(F.concat(F.substring("q", 1, 0), F.lit("milk"))), 0), 0)
    return names.select("q", F.concat(F.lit("milk|"), milk).alias("fixed_case"), as_text(F.get(v, 0)).alias("first_variant"),
                        as_text(F.element_at(v, -1)).alias("last_variant"))


@query("greeklish_to_greek", "SELECT p_partkey, " + GREEKLISH.replace("trim(q)", "p_name") + " AS greek FROM part")
def greeklish(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", greeklish_to_greek("p_name").alias("greek"))


@query("iota_canonical", "SELECT p_partkey, translate(" + GREEKLISH.replace("trim(q)", "p_name") + ", 'ηυ', 'ιι') AS canonical FROM part")
def iota(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", iota_canonical(greeklish_to_greek("p_name")).alias("canonical"))


@query("join_substitutes", """
    WITH words AS (SELECT DISTINCT split_part(normalized_name, ' ', 1) AS w FROM v_products),
    pool AS (SELECT w, p.*, row_number() OVER (PARTITION BY w ORDER BY price, id) AS rn FROM words JOIN v_products p ON contains(p.normalized_name, w)),
    ok AS (SELECT a.id, b.id AS alt_id, b.supermarket AS alt_store, b.price AS alt_price, row_number() OVER (PARTITION BY a.id ORDER BY b.price, b.id) AS rank
      FROM v_products a JOIN pool b ON b.w = split_part(a.normalized_name, ' ', 1) AND b.rn <= 30
      WHERE b.price > 0 AND (lower(b.supermarket) <> lower(a.supermarket) OR b.price < a.price))
    SELECT id, rank, alt_id, alt_store, alt_price FROM ok WHERE rank <= 3""", ("v_products",))
def join_substitutes(spark, d):
    return search.substitutes(tables.products(spark, d))


@query("substitute_norm", "SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS word FROM part")
def substitute_word(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", search.substitute_norm("p_name").alias("word"))


@query("topk_offers", """
    SELECT order_key, product_id, store_id, price, discount_percent, epoch_us(date_scraped) AS scraped_us FROM v_offers
    WHERE is_on_sale AND price > 0 ORDER BY discount_percent DESC, date_scraped DESC, pos DESC LIMIT 20""", ("v_offers",))
def topk_offers(spark, d):
    return search.top_offers(tables.offers(spark, d), 20).select(
        "order_key", "product_id", "store_id", "price", "discount_percent", epoch_micros("date_scraped").alias("scraped_us"))


FT = lambda field, weight: f"""CASE WHEN len([w FOR w IN {field} IF w IN ('the', 'la', 'que')]) > 0 THEN
    (len([w FOR w IN {field} IF w IN ('the', 'la', 'que')]) / greatest(len({field}), 1) + 0.5) * {weight} ELSE 0.0 END"""
TOKENS = "[w FOR w IN regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+') IF w <> '']"


@query("fulltext_score", f"""
    WITH f AS (SELECT id, {TOKENS.format('title')} AS tt, {TOKENS.format("array_to_string(ingredients, ' ')")} AS ti, {TOKENS.format('description')} AS td FROM v_recipes),
    s AS (SELECT id, CAST({FT('tt', 10)} AS DOUBLE) + CAST({FT('ti', 5)} AS DOUBLE) + CAST({FT('td', 1)} AS DOUBLE) AS score FROM f)
    SELECT id, floor(score * 10000 + 0.5) / 10000 AS score FROM s WHERE score > 0""", ("v_recipes",))
def fulltext_score(spark, d):
    r = tables.recipes(spark, d)
    score = fs.fulltext_score(F.lit(["the", "la", "que"]), title="title", ingredients=F.concat_ws(" ", "ingredients"), description="description")
    return add_kept(r, "s", score, lambda s: s > 0).select("id", (F.floor(F.col("s") * 10000 + 0.5) / 10000).alias("score"))


#: Searches as users type them: the first three words of each conversation; of one in ten only the first letter.
SEARCHES = """v_searches AS (SELECT conv_id AS qid, CASE WHEN conv_id % 10 = 0 THEN left(text, 1) ELSE array_to_string(string_split(text, ' ')[1:3], ' ') END AS q
      FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)"""


def user_searches(spark, d):
    first = keep_first(tables.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text"), ["conv_id"], ["turn"])
    words = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return first.select(F.col("conv_id").alias("qid"), F.when(F.col("conv_id") % 10 == 0, F.left("text", F.lit(1))).otherwise(words).alias("q"))


@query("recipe_search", f"""
    WITH {SEARCHES},
    f AS (SELECT id, created_at, {TOKENS.format('title')} AS tt, {TOKENS.format("array_to_string(ingredients, ' ')")} AS ti, {TOKENS.format('description')} AS td FROM v_recipes),
    w AS (SELECT id, 10 AS weight, len(tt) AS n, unnest(tt) AS term FROM f UNION ALL SELECT id, 5, len(ti), unnest(ti) FROM f UNION ALL SELECT id, 1, len(td), unnest(td) FROM f),
    h AS (SELECT id, weight, n, term, count(*) AS hits FROM w GROUP BY ALL),
    a AS (SELECT DISTINCT qid, unnest({TOKENS.format('q')}) AS term FROM v_searches WHERE length(q) >= 2),
    fs AS (SELECT qid, id, weight, (CAST(sum(hits) AS DOUBLE) / any_value(n) + 0.5) * weight AS part FROM a JOIN h USING (term) GROUP BY qid, id, weight),
    s AS (SELECT qid, id, floor((coalesce(sum(part) FILTER (WHERE weight = 10), 0) + coalesce(sum(part) FILTER (WHERE weight = 5), 0)
      + coalesce(sum(part) FILTER (WHERE weight = 1), 0)) * 10000 + 0.5) / 10000 AS score FROM fs GROUP BY qid, id)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, created_at DESC, id) AS rank, id, score FROM s JOIN f USING (id) QUALIFY rank <= 20
    UNION ALL SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY created_at DESC, id) AS rank, id, CAST(NULL AS DOUBLE)
      FROM v_searches JOIN v_recipes ON contains(lower(title || ' ' || array_to_string(ingredients, ' ')), lower(q)) WHERE length(q) = 1 AND trim(q) <> '' QUALIFY rank <= 20""", ("v_recipes",))
def recipe_search(spark, d):
    """Best 20 recipes of every user search."""
    records = tables.recipes(spark, d).withColumn("ingredients", F.concat_ws(" ", "ingredients"))
    return fulltext.search(records, user_searches(spark, d), "created_at", 20, title="title", ingredients="ingredients", description="description")


@query("norm_text", "SELECT doc_id, trim(strip_accents(lower(text)), chr(32) || chr(10)) AS norm FROM documents")
def norm(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", norm_text("text").alias("norm"))
