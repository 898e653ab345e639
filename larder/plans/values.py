"""Numbers, dates, arrays and JSON over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import dates as dt
from larder.functions import fixed_values as fv
from larder.functions import numbers as nm
from larder.functions import structures as st
from larder.functions import text as tx
from larder.operators.scaling import add_kept
from larder.plans.joins import ACCESS, access
from larder.plans.registry import query
from larder.sources import tables


def price_sql(x):
    t = f"trim(regexp_replace(replace({x}, '€', ''), '\\s+', ' ', 'g'))"
    dec = f"TRY_CAST(replace(regexp_extract({t}, '^[0-9]+[,.][0-9]+'), ',', '.') AS DOUBLE)"
    return f"""CASE WHEN regexp_matches({t}, '^[0-9]+[,.][0-9]+') THEN CASE WHEN {dec} > 300 THEN {dec} / 100 ELSE {dec} END
      WHEN regexp_full_match({t}, '[0-9]+ [0-9]{{1,2}}') THEN TRY_CAST(split_part({t}, ' ', 1) AS DOUBLE) + TRY_CAST(split_part({t}, ' ', 2) AS DOUBLE) / 100
      WHEN regexp_full_match({t}, '[0-9]+') THEN CASE WHEN TRY_CAST({t} AS DOUBLE) > 99 THEN TRY_CAST({t} AS DOUBLE) / 100 ELSE TRY_CAST({t} AS DOUBLE) END END"""


line = lambda spark, d: tables.table(spark, d, "lineitem")
events = lambda spark, d: tables.table(spark, d, "events")


@query("parse_price", f"SELECT event_id, price_text, {price_sql('price_text')} AS price FROM v_price_text", ("v_price_text",))
def parse_price(spark, d):
    return tables.price_texts(spark, d).select("event_id", "price_text", nm.parse_price("price_text").alias("price"))


@query("unit_price_guard", f"SELECT event_id, CASE WHEN contains(price_text, '/kg') THEN split_part(price_text, '/', 1) ELSE price_text END AS part, {price_sql('price_text')} AS price FROM v_price_text", ("v_price_text",))
def unit_price_guard(spark, d):
    guarded = nm.unit_price_guard("price_text")
    return tables.price_texts(spark, d).select("event_id", guarded.alias("part"), nm.parse_price(guarded).alias("price"))


@query("split_price", f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 50 AS DOUBLE) + 0.25 WHEN 1 THEN
      CASE WHEN event_id % 1200 + event_id % 100 / 100 > 0 AND event_id % 1200 + event_id % 100 / 100 < 999 THEN event_id % 1200 + event_id % 100 / 100 ELSE {price_sql('price_text')} END
      ELSE {price_sql('price_text')} END AS price FROM v_price_text""", ("v_price_text",))
def split_price(spark, d):
    i = F.col("event_id")
    shown = lambda c: F.when(i % 3 == 1, c.cast("string"))
    price = nm.split_price(F.when(i % 3 == 0, F.concat((i % 50).cast("string"), F.lit(".25"))), shown(i % 1200), shown(i % 100), "price_text")
    return tables.price_texts(spark, d).select("event_id", price.alias("price"))


@query("sale_price_rule", """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount > 0 THEN l_extendedprice - l_quantity ELSE l_extendedprice END AS price,
    CASE WHEN l_discount > 0 THEN l_extendedprice END AS old_price, l_discount > 0 AS is_on_sale FROM lineitem""")
def sale_price_rule(spark, d):
    cut = F.when(F.col("l_discount") > 0, F.col("l_extendedprice") - F.col("l_quantity"))
    return line(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", nm.sale_price_rule("l_extendedprice", cut).alias("s")).select(
        "l_orderkey", "l_linenumber", "l_quantity", "s.*")


@query("round_1dp", """SELECT l_orderkey, l_linenumber, l_quantity, floor(l_extendedprice / 7 * 10 + 0.5) / 10 AS r1,
    CASE WHEN l_extendedprice - 20000 >= 0 THEN floor((l_extendedprice - 20000) * 10 + 0.5) / 10 END AS positive FROM lineitem""")
def round_1dp(spark, d):
    return line(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", nm.js_round(F.col("l_extendedprice") / 7, 1).alias("r1"),
                                 nm.estimate_1dp(F.col("l_extendedprice") - 20000).alias("positive"))


@query("clamp_macro", """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN floor(l_extendedprice - 500 + 0.5) >= 0 THEN CAST(least(floor(l_extendedprice - 500 + 0.5), 9999) AS BIGINT) END AS kcal FROM lineitem""")
def clamp_macro(spark, d):
    return line(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", nm.clamp_macro(F.col("l_extendedprice") - 500).alias("kcal"))


@query("to_int_prefix", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) ELSE 0 END AS n FROM events""")
def to_int_prefix(spark, d):
    i = F.col("event_id") % 3
    text = F.when(i == 0, F.replace("props", F.lit('{"k": '), F.lit(" "))).when(i == 1, "-3 x").otherwise("x9")
    return events(spark, d).select("event_id", nm.int_prefix(text).alias("n"))


@query("health_score_valid", """SELECT doc_id, CAST(CASE WHEN doc_id % 14 BETWEEN 1 AND 10 THEN doc_id % 14 ELSE 5 END AS INT) AS score, doc_id % 900 < 600 AS light FROM labels""")
def health_score_valid(spark, d):
    k = F.col("doc_id")
    return tables.table(spark, d, "labels").select("doc_id", nm.health_score(k % 14).alias("score"), (k % 900 < 600).alias("light"))


@query("difficulty", """SELECT doc_id, CASE WHEN n_chars % 90 = 0 THEN 'Μέτρια' WHEN n_chars % 90 <= 20 AND doc_id % 15 <= 6 THEN 'Εύκολη' WHEN n_chars % 90 <= 45 AND doc_id % 15 <= 12 THEN 'Μέτρια' ELSE 'Δύσκολη' END AS web,
    CASE WHEN coalesce(nullif(n_chars % 90, 0), 30) <= 20 AND doc_id % 15 <= 6 THEN 'Εύκολη' WHEN coalesce(nullif(n_chars % 90, 0), 30) <= 45 AND doc_id % 15 <= 12 THEN 'Μέτρια' ELSE 'Δύσκολη' END AS api FROM documents""")
def difficulty(spark, d):
    m, n = F.col("n_chars") % 90, F.col("doc_id") % 15
    return tables.table(spark, d, "documents").select("doc_id", st.difficulty(m, n).alias("web"), st.difficulty(m, n, 30).alias("api"))


# --- dates ----------------------------------------------------------------------

@query("iso_duration_minutes", "SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 60 + event_id % 60 END AS INT) AS minutes FROM events")
def iso_duration_minutes(spark, d):
    raw = F.get_json_object("payload", "$.totalTime")
    text = F.when(F.col("event_id") % 5 != 0, raw)
    return tables.api_payloads(spark, d).select("event_id", nm.falsy_to_null(dt.iso_duration_minutes(text)).alias("minutes"))


@query("access_state", ACCESS, ("v_users",))
def access_state(spark, d):
    return access(spark, d)


@query("trial_end_default", "SELECT o_orderkey, epoch_us(o_orderdate + INTERVAL 14 DAY) AS ends_us FROM orders")
def trial_end_default(spark, d):
    return tables.table(spark, d, "orders").select("o_orderkey", dt.epoch_micros(dt.trial_end_default("o_orderdate")).alias("ends_us"))


@query("ttl_live", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def ttl_live(spark, d):
    return events(spark, d).where(dt.ttl_live("ts", dt.ntz("2024-01-20 00:00:00"))).select("event_id")


@query("default_values", """SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE lang END, 'Διεθνής') AS cuisine, coalesce(l.quality, 4) AS servings,
    CASE WHEN d.doc_id % 8 < 5 THEN ['different_recipes','lighter','cheaper','faster','more_variety'][d.doc_id % 8 + 1] WHEN d.doc_id % 8 = 5 THEN 'other' END AS reason, d.doc_id % 8 <= 5 AS accepted
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def default_values(spark, d):
    """Missing fields take their defaults; a reason outside the list is refused."""
    k = F.col("doc_id") % 8
    given = F.when(k == 5, None).otherwise(F.get(F.lit(fv.FEEDBACK_REASONS[:5] + ["", "boring", "spicy"]), k.cast("int")))
    reason = F.coalesce(given, F.lit("other"))
    docs = tables.table(spark, d, "documents").join(tables.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    ok = reason.isin(*fv.FEEDBACK_REASONS)
    return docs.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.lit(fv.DEFAULT_CUISINE)).alias("cuisine"),
                       F.coalesce("quality", F.lit(4)).alias("servings"), F.when(ok, reason).alias("reason"), ok.alias("accepted"))


# --- JSON -----------------------------------------------------------------------

@query("jsonld_recipe", """SELECT event_id, event_type AS name, CAST(4 + event_id % 3 AS VARCHAR) || ' servings' AS yield, 'salt|' || event_type AS ingredients, 'a.jpg' AS image,
    CAST(60 + event_id % 60 AS INT) AS minutes FROM events WHERE event_id % 4 <> 3""")
def jsonld_recipe(spark, d):
    i = F.col("event_id")
    recipe = F.concat(
        F.lit('{"@type":"Recipe","name":"'), "event_type", F.lit('","recipeYield":"'), (4 + i % 3).cast("string"), F.lit(' servings","image":'),
        F.when(i % 3 == 0, '["a.jpg","b.jpg"]').when(i % 3 == 1, '{"url":"a.jpg"}').otherwise('"a.jpg"'),
        F.lit(',"totalTime":"PT1H'), (i % 60).cast("string"), F.lit('M","recipeIngredient":["salt","'), "event_type", F.lit('"]}'))
    body = F.when(i % 4 == 0, recipe).when(i % 4 == 3, "not json").otherwise(F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), recipe, F.lit("]}")))
    page = F.concat(F.lit('<head><script type="application/ld+json">{"@type":"WebSite"}</script><script type=\'application/ld+json\'>'), body, F.lit("</script></head>"))
    parsed = add_kept(events(spark, d), "r", st.jsonld_fields(st.jsonld_recipe(page)), lambda r: r["name"].isNotNull())
    return parsed.select("event_id", F.col("r.name").alias("name"), F.col("r.recipeYield").alias("yield"), tx.as_text("r.recipeIngredient").alias("ingredients"),
                         st.first_image("r.image").alias("image"), dt.iso_duration_minutes("r.totalTime").alias("minutes"))


@query("offer_tile_json", """SELECT event_id, event_type AS name, value AS price, '-' || CAST(event_id % 50 AS VARCHAR) || '%' AS discount_percent, true AS is_on_sale, false AS is_1plus1
    FROM events WHERE event_id % 7 <> 0 AND value > 0""")
def offer_tile_json(spark, d):
    tile = add_kept(tables.api_payloads(spark, d), "t", st.parse_tile("payload"), st.in_stock)
    o = add_kept(tile, "o", st.offer_from_tile(F.col("t")), lambda o: (o["name"] != "") & (o["price"] > 0))
    return o.select("event_id", "o.name", "o.price", "o.discount_percent", "o.is_on_sale", "o.is_1plus1")


@query("llm_json_extract", """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS k, event_id % 3 = 2 AS rejected FROM events""")
def fenced_json(spark, d):
    i = F.col("event_id") % 3
    reply = F.when(i == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i == 1, F.concat(F.lit("Sure: "), "props", F.lit(" as asked"))).otherwise("no {json here")
    e = events(spark, d).select("event_id", st.fenced_json(reply).alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.k").try_cast("int").alias("k"), F.col("j").isNull().alias("rejected"))


@query("scan_result_valid", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence, CAST(CASE WHEN event_id % 14 BETWEEN 1 AND 10 THEN event_id % 14 ELSE 5 END AS INT) AS health_score,
    CASE WHEN event_id % 4 = 1 THEN event_type ELSE 'κυρίως γεύμα' END AS meal_type, CASE WHEN event_id % 2 = 0 THEN 'a|b c|d' END AS choices FROM events""")
def scan_result_valid(spark, d):
    i = F.col("event_id")
    body = F.concat(
        F.lit('{"confidence":"'), F.when(i % 3 == 0, "high").otherwise("sure"), F.lit('","healthScore":'), (i % 14).cast("string"),
        F.lit(',"mealType":"'), F.when(i % 4 == 1, F.concat(F.lit(" "), "event_type")).otherwise("  "), F.lit('","question":'),
        F.when(i % 2 == 0, '{"text":" why? ","choices":["a"," b  c","","d","e"]}').when(i % 2 == 1, '{"text":"x","choices":[""]}'), F.lit("}"))
    r = events(spark, d).select("event_id", st.scan_result(F.from_json(body, st.SCAN_SCHEMA)).alias("r"))
    return r.select("event_id", "r.confidence", "r.health_score", "r.meal_type", F.when(F.col("r.question").isNotNull(), tx.as_text("r.question.choices")).alias("choices"))


@query("macro_text_extract", """SELECT event_id, CAST(nullif(event_id % 900, 0) AS DOUBLE) AS calories, CAST(nullif(event_id % 7, 0) AS DOUBLE) + 0.5 AS fat, CASE event_id % 3 WHEN 0 THEN 'calories' WHEN 1 THEN 'protein' ELSE 'fat' END AS field,
    CAST(event_id % 50 + 1 AS DOUBLE) AS fact FROM events""")
def macro_text_extract(spark, d):
    i = F.col("event_id")
    flat = F.concat((i % 900).cast("string"), F.lit("Θερμίδες "), F.when(i % 7 == 0, "").otherwise(F.concat((i % 7).cast("string"), F.lit(".5ΛΙΠΑΡΆ "))))
    fact = F.concat((i % 50 + 1).cast("string"), F.get(F.lit([" kcal", " γρ ΠΡΩΤΕΐΝΕΣ", "g λιπαρά"]), (i % 3).cast("int")))
    n = st.labelled_numbers(flat, st.FLAT_LABELS)
    f = st.fact_of_line(fact)
    return events(spark, d).select("event_id", n["calories"].alias("calories"), n["fat"].alias("fat"), f["field"].alias("field"), f["value"].alias("fact"))


@query("minutes_sum", "SELECT event_id, nullif(event_id % 60 + event_id % 30, 0) AS minutes FROM events")
def minutes_sum(spark, d):
    i = F.col("event_id")
    text = F.concat(F.lit("prep "), (i % 60).cast("string"), F.lit("' cook "), (i % 30).cast("string"), F.lit("' rest 9 min"))
    return events(spark, d).select("event_id", st.minutes_sum(text).alias("minutes"))


@query("servings_extract", "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 2 ELSE event_id % 4 END AS INT) AS servings FROM events")
def servings_extract(spark, d):
    i = F.col("event_id") % 4
    text = F.when(i == 0, "many").otherwise(F.concat(F.lit("serves "), i.cast("string"), F.lit(" or 9")))
    return events(spark, d).select("event_id", st.servings_of(text, 2).alias("servings"))


@query("image_choice", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://x.example/a' || event_id || '.jpg' WHEN 1 THEN 'https://lazy.example/b.jpg' WHEN 2 THEN 'https://set.example/c.jpg' END AS image FROM events""")
def image_choice(spark, d):
    i = F.col("event_id") % 4
    src = F.when(i == 0, F.concat(F.lit("https://x.example/a"), F.col("event_id").cast("string"), F.lit(".jpg"))).when(i == 1, "data:image/gif;base64,R0lGODlhAQABAIAAAAAAAP").when(i == 3, "x.gif")
    return events(spark, d).select("event_id", st.image_choice(
        src, F.when(i == 1, "https://lazy.example/b.jpg"), F.lit(""), srcset=F.when(i == 2, "https://set.example/c.jpg 1x, https://set.example/d.jpg 2x")).alias("image"))


@query("promo_flags", "SELECT p_partkey, p_type IN ('PROMO', 'SMALL', 'LARGE') AS is_on_sale, p_type IN ('SMALL') AS is_1plus1 FROM part")
def promo_flags(spark, d):
    t = F.col("p_type")
    promos = F.array(F.when(t == "PROMO", "-20%").when(t == "SMALL", "1+1 ΔΏΡΟ").when(t == "LARGE", "Super τιμή").otherwise("νέο"), F.lit("νέο προϊόν"))
    return tables.table(spark, d, "part").select("p_partkey", st.promo_flags(promos).alias("f")).select("p_partkey", "f.*")


@query("brand_name_merge", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'data ' || p_name WHEN 1 THEN p_brand || ' ' || p_name WHEN 2 THEN p_name ELSE p_type END AS name FROM part""")
def brand_name_merge(spark, d):
    k = F.col("p_partkey") % 4
    data = F.get_json_object(F.when(k == 0, F.concat(F.lit('{"name":"data '), "p_name", F.lit('"}'))), "$.name")
    return tables.table(spark, d, "part").select("p_partkey", st.brand_name(
        data, F.when(k == 1, F.col("p_brand")), F.when(k != 3, F.col("p_name")), "p_type").alias("name"))


@query("recipe_tags_web", """SELECT id, array_to_string([t FOR t IN [CASE WHEN protein > 25 THEN 'high-protein' END, CASE WHEN coalesce(calories, 0) < 400 THEN 'healthy' END, CASE WHEN coalesce(nullif(carbs, 0), 999) < 15 THEN 'low-carb' END,
    CASE WHEN coalesce(nullif(fat, 0), 999) < 8 THEN 'low-fat' END, CASE WHEN minutes > 0 AND minutes <= 25 THEN 'quick' END] IF t IS NOT NULL], '|') AS tags FROM v_recipes""", ("v_recipes",))
def recipe_tags_web(spark, d):
    tags = st.recipe_tags_web("protein", "calories", "carbs", "fat", F.lit(None).cast("int"), "minutes")
    return tables.recipes(spark, d).select("id", tx.as_text(tags).alias("tags"))


@query("recipe_tags_api", """SELECT id, array_to_string([t FOR t IN [CASE WHEN id % 2 = 0 OR minutes > 70 THEN 'healthy' END, CASE WHEN minutes <= 25 THEN 'quick' END, CASE WHEN id % 3 = 0 THEN 'vegan' END, CASE WHEN protein > 25 THEN 'high-protein' END,
    CASE WHEN coalesce(calories, 0) < 15 THEN 'low-carb' END, CASE WHEN fat < 10 THEN 'low-fat' END, CASE WHEN id % 4 = 0 THEN 'breakfast' END, CASE WHEN id % 4 = 1 THEN 'dessert' END] IF t IS NOT NULL], '|') AS tags FROM v_recipes""", ("v_recipes",))
def recipe_tags_api(spark, d):
    i = F.col("id")
    dishes = F.array(F.when(i % 4 == 0, "Morning Meal").when(i % 4 == 1, "dessert").otherwise("side dish"))
    tags = st.recipe_tags_api({"very_healthy": i % 2 == 0, "vegan": i % 3 == 0}, "minutes", "minutes", "protein", "calories", "fat", dishes)
    return tables.recipes(spark, d).select("id", tx.as_text(tags).alias("tags"))


@query("category_map_web", """SELECT doc_id, CASE WHEN regexp_matches(t, 'πρωιν|breakfast') THEN 'Πρωινό' WHEN regexp_matches(t, 'σνακ|snack') THEN 'Σνακ' WHEN regexp_matches(t, 'cake|tart|brownie') THEN 'Επιδόρπια'
    WHEN regexp_matches(t, 'smoothie|shake|drink') THEN 'Ροφήματα' ELSE 'Κυρίως' END AS category FROM (SELECT doc_id, lower(text) || CASE doc_id % 5 WHEN 0 THEN ' cake' WHEN 1 THEN ' snack cake' WHEN 2 THEN ' drink' ELSE '' END AS t FROM documents) x""")
def category_map_web(spark, d):
    k = F.col("doc_id") % 5
    hint = F.when(k == 0, "Cake").when(k == 1, "snack cake").when(k == 2, "DRINK").otherwise("")
    return tables.table(spark, d, "documents").select("doc_id", st.category_web("text", hint).alias("category"))


@query("category_map_api", """SELECT id, CASE id % 5 WHEN 0 THEN 'Πρωινό' WHEN 1 THEN 'Σνακ' WHEN 2 THEN 'Επιδόρπια' WHEN 3 THEN 'Ροφήματα' ELSE 'Κυρίως' END AS category FROM v_recipes""", ("v_recipes",))
def category_map_api(spark, d):
    dish = F.get(F.lit(["Morning Meal", "Starter", "sweet", "drink", "main"]), (F.col("id") % 5).cast("int"))
    types = F.when(F.col("id") % 5 == 1, F.array(F.lit("dessert"), dish)).otherwise(F.array(dish))
    return tables.recipes(spark, d).select("id", st.category_api(types).alias("category"))


@query("cuisine_map", """SELECT id, CASE id % 3 WHEN 0 THEN 'Ελληνική' WHEN 1 THEN 'Μέση Ανατολή' ELSE 'Διεθνής' END AS cuisine FROM v_recipes""", ("v_recipes",))
def cuisine_map(spark, d):
    k = F.col("id") % 3
    listed = F.when(k == 0, F.array(F.lit("nowhere"), F.lit("Greek"), F.lit("thai"))).when(k == 1, F.array(F.lit("Middle Eastern"))).otherwise(F.array(F.lit("martian")))
    return tables.recipes(spark, d).select("id", st.cuisine_label(listed).alias("cuisine"))


@query("dietary_flags", "SELECT doc_id, contains(lower(text), 'palm') OR doc_id % 10 = 0 AS has_palm_oil FROM documents")
def dietary_flags(spark, d):
    listed = F.concat("text", F.when(F.col("doc_id") % 10 == 0, " PALM oil").otherwise(""))
    return tables.table(spark, d, "documents").select("doc_id", st.has_palm_oil(listed).alias("has_palm_oil"))
