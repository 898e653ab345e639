"""Sources, sinks and table maintenance over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.dates import epoch_micros
from larder.functions.text import as_text, url_canonical
from larder.operators import catalog, social
from larder.operators.scaling import keep_first, spread
from larder.plans.registry import query
from larder.session import scratch_path
from larder.sources import files, html, ingest, tables


@query("scan_products", """
    SELECT id, name, normalized_name, supermarket, category, price FROM v_products""", ("v_products",))
def scan_products(spark, d):
    return tables.products(spark, d)


@query("scan_recipes", """
    SELECT id, title, category, source_api, minutes, protein, calories, servings,
           epoch_us(created_at) AS created_us FROM v_recipes WHERE len(ingredients) > 0""", ("v_recipes",))
def scan_recipes(spark, d):
    return tables.recipes(spark, d).where(F.size("ingredients") > 0).select(
        "id", "title", "category", "source_api", "minutes", "protein", "calories", "servings",
        epoch_micros("created_at").alias("created_us"),
    )


def store_of_page(c):
    return F.concat(F.lit("store"), F.regexp_extract(c, "/(en|fr|es|de)/", 1))


@query("json_map_sink", """
    SELECT store, count(*) AS n_urls, min(url) AS first_url, max(url) AS last_url FROM (
      SELECT DISTINCT 'store' || regexp_extract(url, '/(en|fr|es|de)/', 1) AS store,
             split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages) t GROUP BY store""")
def json_map_sink(spark, d):
    """Write {store, urls} lines and read them back."""
    links = tables.table(spark, d, "pages").select(store_of_page("url").alias("store"), url_canonical("url").alias("url"))
    path = scratch_path(spark, "link-map")
    files.write_url_map(links, path)
    return (
        files.read_url_map(spark, path)
        .groupBy("store")
        .agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))
    )


@query("json_map_source", """
    SELECT DISTINCT 'storeen' AS store, split_part(split_part(url, '#', 1), '?', 1) AS url
    FROM pages WHERE regexp_extract(url, '/(en|fr|es|de)/', 1) = 'en'""")
def json_map_source(spark, d):
    """Keep one store's list of a url map."""
    links = tables.table(spark, d, "pages").select(store_of_page("url").alias("store"), url_canonical("url").alias("url"))
    path = scratch_path(spark, "link-map")
    files.write_url_map(links, path)
    return files.read_url_map(spark, path, store="storeen")


@query("url_seed_source", """
    SELECT url, 'crawl' AS origin FROM pages UNION ALL
    SELECT * FROM (VALUES ('https://www.ab.gr/el/eshop', 'seed'), ('https://www.lidl-hellas.gr/offers', 'seed')) t(url, origin)
    """)
def url_seed_source(spark, d):
    """Literal seed lists put beside the stored crawl urls."""
    stored = tables.table(spark, d, "pages").select("url", F.lit("crawl").alias("origin"))
    seeds = files.url_seeds(spark, {"ab": ["https://www.ab.gr/el/eshop"], "lidl": ["https://www.lidl-hellas.gr/offers"]})
    return stored.unionByName(seeds.select("url", F.lit("seed").alias("origin")))


API_JSON = """
  SELECT event_id AS id, '{"title":"' || event_type || '","nutrition":{"nutrients":[{"name":"Calories","amount":'
    || CAST(value AS VARCHAR) || '},{"name":"Protein","amount":' || CAST(event_id % 90 AS VARCHAR) || '.5}]},'
    || '"extendedIngredients":[{"original":"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'one ' || event_type END
    || '","amount":2,"unit":"g","name":"salt"}],"analyzedInstructions":'
    || CASE WHEN event_id % 5 = 0 THEN '[]' ELSE '[{"steps":[{"step":"mix"},{"step":""},{"step":"bake ' || event_type || '"}]}]' END
    || CASE WHEN event_id % 10 = 0 THEN ',"instructions":"1. Stir the pot well 2. Short 3. Serve it in a bowl"' ELSE '' END
    || '}' AS payload FROM events"""


@query("api_recipe_ingest", f"""
    SELECT id, json_extract_string(payload, '$.title') AS title,
      CAST(floor(CAST(json_extract_string(payload, '$.nutrition.nutrients[0].amount') AS DOUBLE) + 0.5) AS BIGINT) AS calories,
      CAST(floor(CAST(json_extract_string(payload, '$.nutrition.nutrients[1].amount') AS DOUBLE) + 0.5) AS BIGINT) AS protein,
      CASE WHEN id % 3 = 0 THEN '2 g salt' ELSE json_extract_string(payload, '$.extendedIngredients[0].original') END AS ingredients,
      CASE WHEN id % 5 <> 0 THEN 'mix|bake ' || json_extract_string(payload, '$.title')
           ELSE 'Stir the pot well|Serve it in a bowl' END AS instructions
    FROM ({API_JSON}) t WHERE id % 5 <> 0 OR id % 10 = 0""")
def api_recipe_ingest(spark, d):
    raw = tables.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(API_EXPR).alias("payload"))
    flat = ingest.api_recipes(raw, "id", "payload")
    return flat.select("id", "title", "calories", "protein", as_text("ingredients").alias("ingredients"),
                       as_text("instructions").alias("instructions"))


API_EXPR = API_JSON[API_JSON.index("'{\"title\""):API_JSON.index(" AS payload")].replace("VARCHAR", "STRING")


@query("wide_payload_to_array", """
    WITH w AS (SELECT l_orderkey AS id, l_linenumber AS i, min(l_partkey) AS part, min(l_quantity) AS qty
               FROM lineitem GROUP BY 1, 2)
    SELECT id, string_agg(CASE WHEN part % 5 = 0 THEN 'part' || part ELSE CAST(CAST(qty AS INT) AS VARCHAR) || 'g part' || part END,
           '|' ORDER BY i) AS ingredients, count(*) AS n FROM w WHERE part % 11 <> 0 GROUP BY id""")
def wide_payload_to_array(spark, d):
    """Numbered name/measure columns (strIngredient1..) to one array of 'measure name'."""
    line = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    slots = range(1, 8)
    at = lambda i, e: F.min(F.when(F.col("l_linenumber") == i, e))
    wide = line.groupBy(F.col("l_orderkey").alias("id")).agg(
        *[at(i, F.col("l_partkey")).alias(f"p{i}") for i in slots],
        *[at(i, F.col("l_quantity")).alias(f"q{i}") for i in slots],
    )
    named = wide.select(
        "id",
        *[F.when(F.col(f"p{i}") % 11 != 0, F.concat(F.lit(" part"), F.col(f"p{i}").cast("string"))).alias(f"strIngredient{i}") for i in slots],
        *[F.when(F.col(f"p{i}") % 5 != 0, F.concat(F.col(f"q{i}").cast("int").cast("string"), F.lit("g "))).alias(f"strMeasure{i}") for i in slots],
    )
    items = ingest.wide_to_array(named.columns)
    return named.select("id", items.alias("a")).where(F.size("a") > 0).select(
        "id", as_text("a").alias("ingredients"), F.size("a").cast("bigint").alias("n"))


@query("nutrition_payload_ingest", """
    SELECT event_id AS barcode, source, name, kcal, proteins, sodium, salt FROM (
      SELECT event_id, 'usda' AS source, event_type AS name, floor(value * 10 + 0.5) / 10 AS kcal,
        CAST(event_id % 40 AS DOUBLE) AS proteins, floor(CAST(event_id % 300 AS DOUBLE) / 7 * 10 + 0.5) / 10 AS sodium,
        floor(floor(CAST(event_id % 300 AS DOUBLE) / 7 * 10 + 0.5) / 10 * 2.5 * 10 + 0.5) / 10 AS salt FROM events WHERE event_id % 3 = 0
      UNION ALL
      SELECT event_id, 'edamam', event_type, floor(value * 10 + 0.5) / 10, CAST(event_id % 40 AS DOUBLE), NULL, NULL FROM events WHERE event_id % 3 = 1
      UNION ALL
      SELECT event_id, 'nutritionix', event_type, floor(value + 0.5), CAST(event_id % 40 AS DOUBLE),
        floor(CAST(event_id % 300 AS DOUBLE) / 7 * 10 + 0.5) / 10, floor(CAST(event_id % 300 AS DOUBLE) / 7 * 2.5 * 10 + 0.5) / 10 FROM events WHERE event_id % 3 = 2) t""")
def nutrition_payload_ingest(spark, d):
    ev = tables.table(spark, d, "events").select("event_id", "event_type", "value")
    num = lambda name, v: F.struct(F.lit(name).alias("nutrientId"), v.alias("value"))
    protein = (F.col("event_id") % 40).cast("double")
    sodium = (F.col("event_id") % 300).cast("double") / 7
    usda = ev.where("event_id % 3 = 0").select(
        F.col("event_id").alias("barcode"), F.col("event_type").alias("description"),
        F.array(num(1008, F.col("value")), num(1003, protein), num(1093, sodium)).alias("foodNutrients"))
    edamam = ev.where("event_id % 3 = 1").select(
        F.col("event_id").alias("barcode"), F.col("event_type").alias("label"),
        F.create_map(F.lit("ENERC_KCAL"), F.col("value"), F.lit("PROCNT"), protein).alias("nutrients"))
    nutritionix = ev.where("event_id % 3 = 2").select(
        F.col("event_id").alias("barcode"), F.col("event_type").alias("food_name"),
        F.col("value").alias("nf_calories"), protein.alias("nf_protein"), sodium.alias("nf_sodium"))
    one = ingest.nutrition_products(usda, edamam, nutritionix)
    return one.select("barcode", "source", "name", "kcal", "proteins", "sodium", "salt")


@query("html_page_source", """
    SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title_html,
           trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) AS h1_html FROM pages""")
def html_page_source(spark, d):
    """Title and first heading taken from the parsed page, with entities put back for the check."""
    parsed = html.parse_pages(tables.table(spark, d, "pages").select("page_id", "html"))
    escaped = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    return parsed.select("page_id", escaped("title").alias("title_html"), escaped("h1").alias("h1_html"))


CARD = """'<html><body><div class="product"><h4><a>' || p_name || '</a></h4><span class="price">' ||
    CAST(p_size AS VARCHAR) || ',50 €</span>' || CASE WHEN p_partkey % 2 = 0 THEN '<del>99,00 €</del><span class="offer-span">-20%</span>' ELSE '' END
    || '<figure><img src="https://img.example.com/' || CAST(p_partkey AS VARCHAR) || '.jpg"></figure></div>'
    || '<div class="product"><h4>no price</h4></div></body></html>'"""


@query("html_card_extract", """
    SELECT p_partkey AS page_id, p_name AS name, lower(p_name) AS normalized_name, CAST(p_size AS DOUBLE) + 0.5 AS price,
      CASE WHEN p_partkey % 2 = 0 THEN CAST(99 AS DOUBLE) END AS old_price, p_partkey % 2 = 0 AS is_on_sale, false AS is_1plus1,
      'https://img.example.com/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_url FROM part""")
def html_card_extract(spark, d):
    """Product cards of stored listing pages; cards without a price are dropped."""
    part = spread(tables.table(spark, d, "part").select("p_partkey", "p_name", "p_size"))
    pages = part.select(
        F.col("p_partkey").alias("page_id"), F.expr(CARD.replace("VARCHAR", "STRING")).alias("html"))
    return html.extract_cards(pages, "Σκλαβενίτης").select(
        "page_id", "name", "normalized_name", "price", "old_price", "is_on_sale", "is_1plus1", "image_url")


@query("store_card_extract", """
    WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS s, p_partkey // 8 % 2 = 0 AS card, p_partkey // 16 % 3 AS bare, p_partkey % 3 = 0 AS sale, * FROM part),
    r AS (SELECT *, CASE WHEN s = 0 THEN p_brand || ' ' || p_name ELSE p_name END AS shown, CASE WHEN s = 6 THEN 'https://galaxias.shop/api/media/' ELSE 'https://img.example.com/' END AS folder FROM p),
    -- without a card element: one store's names count as their own wrappers and hold nothing, another's link and heading are lifted to two
    places AS (SELECT r.*, unnest(CASE WHEN card THEN [0] WHEN s = 0 THEN [] WHEN s = 1 AND bare = 1 THEN [0, 1] ELSE [0] END) AS pos FROM r)
    SELECT k AS page_id, pos, shown AS name, lower(shown) AS normalized_name,
      ['ΑΒ Βασιλόπουλος', 'Σκλαβενίτης', 'Κρητικός', 'MyMarket', 'Μασούτης', 'Market In', 'Γαλαξίας', 'Lidl'][s + 1] AS supermarket, p_size + CAST(0.5 AS DOUBLE) AS price,
      CASE WHEN sale AND s <> 6 THEN CAST(99 AS DOUBLE) END AS old_price, sale AS is_on_sale, sale AND s = 0 AS is_1plus1,
      CASE WHEN s <> 7 THEN folder || CAST(k AS VARCHAR) || '.jpg' END AS image_url, CASE WHEN s = 7 THEN '1.1. - 7.1.' END AS validity_date,
      CASE WHEN s = 7 AND sale THEN '-30%' END AS discount_percent FROM places""")
def store_card_extract(spark, d):
    """Products of listing pages of all stores; half of the pages show no card of their store."""
    return html.extract_cards(tables.store_pages(spark, d))


@query("html_link_extract", """
    SELECT DISTINCT page_id, href FROM v_links WHERE href LIKE '/%' AND href NOT LIKE '%,%'""", ("v_links",))
def html_link_extract(spark, d):
    links = html.page_links(tables.table(spark, d, "pages")).select("page_id", "href")
    return links.where(F.startswith(F.col("href"), F.lit("/")) & ~F.col("href").contains(",")).distinct()


@query("upsert_by_key", """
    WITH o AS (SELECT product_id, store_id, price, is_on_sale, pos, order_key % 2 AS half FROM v_offers),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY half DESC, pos DESC) AS rn FROM o
               WHERE half = 1 OR (product_id, store_id, pos) IN (SELECT product_id, store_id, max(pos) FROM o WHERE half = 0 GROUP BY 1, 2))
    SELECT product_id, store_id, price, is_on_sale FROM ranked WHERE rn = 1""", ("v_offers",))
def upsert_by_key(spark, d):
    """Second half of the price observations upserted into the first half."""
    o = tables.offers(spark, d)
    cols = ["product_id", "store_id", "price", "is_on_sale"]
    target = keep_first(o.where("order_key % 2 = 0"), ["product_id", "store_id"], [F.col("pos").desc()]).select(cols)
    changes = o.where("order_key % 2 = 1").select(*cols, "pos")
    return catalog.upsert(target, changes, ["product_id", "store_id"], ["pos"])


@query("insert_if_absent", """
    WITH t AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0),
    c AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 3 <> 0)
    SELECT doc_id, CASE WHEN rn = 1 AND text NOT IN (SELECT text FROM t) THEN 'added' ELSE 'skipped' END AS outcome FROM c""")
def insert_if_absent(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return catalog.insert_if_absent(
        docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), ["k"], ["doc_id"]
    ).select("doc_id", "outcome")


@query("fill_missing_update", """
    SELECT r.id, coalesce(nullif(r.calories, 0), u.calories, r.calories) AS calories,
           coalesce(nullif(r.protein, 0), u.protein, r.protein) AS protein
    FROM v_recipes r LEFT JOIN (SELECT doc_id AS id, CAST(100 + quality AS BIGINT) AS calories, CAST(10 + toxic AS BIGINT) AS protein FROM labels) u
    ON r.id = u.id""", ("v_recipes",))
def fill_missing_update(spark, d):
    target = tables.recipes(spark, d).select("id", "calories", "protein")
    updates = tables.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), (F.lit(100) + F.col("quality")).cast("bigint").alias("calories"),
        (F.lit(10) + F.col("toxic")).cast("bigint").alias("protein"))
    return catalog.fill_missing(target, updates, "id", ["calories", "protein"])


@query("replace_upsert", """
    SELECT endpoint, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS rn FROM v_subs) t
    WHERE rn = 1""", ("v_subs",))
def replace_upsert(spark, d):
    return catalog.replace_upsert(tables.subscriptions(spark, d), ["endpoint"], ["ts", "event_id"]).select(
        "endpoint", "event_id", "user_id")


@query("delete_by_predicate", """
    SELECT list_id, user_id FROM v_lists WHERE NOT (list_id % 5 = 0 AND user_id % 2 = 0) AND user_id % 97 <> 0""", ("v_lists",))
def delete_by_predicate(spark, d):
    """Delete by (id, owner), then everything of some owners."""
    lists = tables.lists(spark, d).select("list_id", "user_id")
    asked = lists.where("list_id % 5 = 0").withColumn("user_id", F.col("user_id") - F.col("user_id") % 2)
    owners = tables.users(spark, d).where("id % 97 = 0").select(F.col("id").alias("user_id"))
    one = catalog.delete_matching(lists, asked, ["list_id", "user_id"])
    return catalog.delete_matching(one, owners, ["user_id"])


@query("owner_scoped_update", """
    SELECT list_id, user_id, 'list ' || list_id AS title FROM v_lists WHERE list_id % 4 = 0 AND user_id % 3 = 0""", ("v_lists",))
def owner_scoped_update(spark, d):
    lists = tables.lists(spark, d).select("list_id", "user_id", "title")
    updates = lists.where("list_id % 4 = 0").select(
        "list_id", (F.col("user_id") - F.col("user_id") % 3).alias("user_id"),
        F.concat(F.lit("list "), F.col("list_id").cast("string")).alias("title"))
    return catalog.update_owned(lists, updates, ["list_id", "user_id"], ["title"])


EDGE_CASE = """WITH ex AS (SELECT a, b FROM v_edges WHERE a % 2 = 0),
    req AS (SELECT a, b FROM v_edges UNION ALL SELECT c_custkey, c_custkey FROM customer UNION ALL SELECT c_custkey, c_custkey + 1000000000 FROM customer)"""


@query("edge_add_bidirectional", EDGE_CASE + """,
    ok AS (SELECT a, b FROM req WHERE a <> b AND a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer))
    SELECT a, b FROM (SELECT a, b FROM ok UNION SELECT b, a FROM ok) t EXCEPT SELECT a, b FROM ex""", ("v_edges",))
def edge_add_bidirectional(spark, d):
    half, people = tables.edges(spark, d), tables.users(spark, d).select("id")
    requests = half.unionByName(people.select(F.col("id").alias("a"), F.col("id").alias("b"))).unionByName(
        people.select(F.col("id").alias("a"), (F.col("id") + 1000000000).alias("b")))
    return social.add_edges(half.where("a % 2 = 0"), requests, people)


@query("edge_remove_bidirectional", """
    WITH e AS (SELECT a, b FROM v_edges UNION ALL SELECT b, a FROM v_edges)
    SELECT a, b FROM e WHERE (a, b) NOT IN (SELECT a, b FROM v_edges WHERE a % 3 = 0 UNION SELECT b, a FROM v_edges WHERE a % 3 = 0)""", ("v_edges",))
def edge_remove_bidirectional(spark, d):
    half = tables.edges(spark, d)
    return social.remove_edges(social.both_ways(half), half.where("a % 3 = 0"))


@query("nested_merge_by_key", """
    WITH m AS (SELECT user_id, day, meal_type, max_by(chosen, (ts, event_id)) AS chosen, min((ts, event_id)) AS f FROM v_choices GROUP BY 1, 2, 3)
    SELECT user_id, string_agg(day || meal_type || chosen, '|' ORDER BY f) AS items FROM m GROUP BY user_id""", ("v_choices",))
def nested_merge_by_key(spark, d):
    merged = catalog.merge_nested(tables.choices(spark, d), "user_id", ["day", "meal_type"], "chosen", ["ts", "event_id"])
    text = F.transform("items", lambda s: F.concat(s["day"].cast("string"), s["meal_type"], s["chosen"]))
    return merged.select("user_id", as_text(text).alias("items"))


@query("backfill_missing", """
    WITH c AS (SELECT id FROM v_recipes WHERE calories IS NULL AND len(ingredients) > 0)
    SELECT count(*) AS total, count(*) FILTER (WHERE id % 4 <> 0) AS updated, CAST(coalesce(sum(id % 4 * 100), 0) AS BIGINT) AS kcal_added FROM c""", ("v_recipes",))
def backfill_missing(spark, d):
    """Estimates applied where non-zero; reports updated of total."""
    missing = tables.recipes(spark, d).where(F.col("calories").isNull() & (F.size("ingredients") > 0)).select("id")
    estimates = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 * 100).alias("estimate"))
    done = missing.join(estimates, "id", "left").withColumn("ok", F.coalesce(F.col("estimate"), F.lit(0)) != 0)
    return done.agg(F.count("*").alias("total"), F.count_if("ok").alias("updated"),
                    F.coalesce(F.sum("estimate"), F.lit(0)).alias("kcal_added"))
