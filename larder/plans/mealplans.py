"""Meal plans, nutrition and plate scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import numbers as nm
from larder.functions.text import as_text, clean_ingredient_name, extract_grams, strip_quantity
from larder.operators import mealplan, nutrition
from larder.plans.registry import query
from larder.sources import tables
from larder.sources.tables import LINE_ORDER

CLEAN = "lower(trim(split_part(regexp_replace(raw, '^[0-9]+g *', ''), '(', 1)))"
TOTALS = f"""listed AS (SELECT plan_id, {CLEAN} AS ingredient,
      CAST(sum(CAST(regexp_extract(raw, '([0-9]+)g', 1) AS BIGINT)) AS BIGINT) AS total_grams, count(*) AS n_lines, min(raw) AS first_raw
    FROM v_ingredients GROUP BY 1, 2),
  summary AS (SELECT DISTINCT p_partkey % 50 AS plan_id, lower(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' fresh' WHEN 1 THEN ' zzz qqq' ELSE '' END AS ingredient FROM part
    UNION SELECT DISTINCT p_partkey % 50, 'fresh ' || lower(p_name) FROM part WHERE p_partkey % 9 = 0
    UNION SELECT DISTINCT p_partkey % 50, lower(p_name) || ' unlisted' FROM part WHERE p_partkey % 5 = 0),
  totals AS (SELECT * FROM listed UNION ALL SELECT plan_id, ingredient, 0, 0, ingredient FROM summary
    WHERE (plan_id, ingredient) NOT IN (SELECT plan_id, ingredient FROM listed))"""
W = "[w FOR w IN string_split(ingredient, ' ') IF length(w) > 2]"
PRICES = TOTALS + f""",
  asked AS (SELECT DISTINCT ingredient, {W} AS w FROM totals),
  tiers AS (SELECT ingredient, 1 AS tier, w[1:3] AS terms FROM asked UNION ALL SELECT ingredient, 2, w[1:2] FROM asked
    UNION ALL SELECT ingredient, 3, w[1:1] FROM asked UNION ALL SELECT ingredient, 4, w[2:2] FROM asked WHERE len(w) > 1),
  hits AS (SELECT t.ingredient, t.tier, p.id AS product_id, p.name AS product_name, p.price, p.supermarket AS store,
      row_number() OVER (PARTITION BY t.ingredient ORDER BY t.tier, p.price, p.id) AS rn
    FROM tiers t JOIN v_products p ON p.price > 0 AND len(t.terms) > 0 AND len([x FOR x IN t.terms IF contains(p.normalized_name, x)]) = len(t.terms)),
  prices AS (SELECT * FROM hits WHERE rn = 1)"""
SHOPPING = PRICES + """,
  shopping AS (SELECT t.plan_id, t.ingredient, t.total_grams, p.product_id IS NOT NULL AS found, p.store, coalesce(p.product_name, t.ingredient) AS product_name,
      CASE WHEN t.total_grams > 0 THEN least(floor(p.price * t.total_grams / 1000 * 100 + 0.5) / 100, p.price) ELSE p.price END AS cost
    FROM totals t LEFT JOIN prices p ON t.ingredient = p.ingredient)"""
V = ("v_ingredients", "v_products")


def plan_inputs(spark, d):
    """All ingredient lines; summary names, some of which no plan has."""
    part, k = tables.table(spark, d, "part"), F.col("p_partkey")
    suffix = F.when(k % 4 == 0, " fresh").when(k % 4 == 1, " zzz qqq").otherwise("")
    name = F.lower("p_name")
    given = [(part, F.concat(name, suffix)), (part.where("p_partkey % 9 = 0"), F.concat(F.lit("fresh "), name)), (part.where("p_partkey % 5 = 0"), F.concat(name, F.lit(" unlisted")))]
    summary = [rows.select((k % 50).alias("plan_id"), ingredient.alias("ingredient")) for rows, ingredient in given]
    return tables.ingredients(spark, d), summary[0].unionByName(summary[1]).unionByName(summary[2])


def priced_list(spark, d):
    return mealplan.price_plans(*plan_inputs(spark, d), tables.products(spark, d))


@query("agg_ingredient_totals_whole", f"WITH {TOTALS} SELECT * FROM totals", V)
@query("agg_ingredient_totals", f"WITH {TOTALS} SELECT * FROM totals", V)
def agg_ingredient_totals(spark, d):
    return mealplan.ingredient_totals(*plan_inputs(spark, d))


@query("join_tiered_price_whole", f"WITH {PRICES} SELECT ingredient, tier, product_id, price, store FROM prices", V)
@query("join_tiered_price", f"WITH {PRICES} SELECT ingredient, tier, product_id, price, store FROM prices", V)
def join_tiered_price(spark, d):
    prices = mealplan.best_prices(mealplan.ingredient_totals(*plan_inputs(spark, d)), tables.products(spark, d))
    return prices.select("ingredient", "tier", "product_id", "price", "store")


@query("join_shopping_list_whole", f"WITH {SHOPPING} SELECT plan_id, ingredient, total_grams, found, cost, store, product_name FROM shopping", V)
@query("join_shopping_list", f"WITH {SHOPPING} SELECT plan_id, ingredient, total_grams, found, cost, store, product_name FROM shopping", V)
def join_shopping_list(spark, d):
    return priced_list(spark, d).select("plan_id", "ingredient", "total_grams", "found", "cost", "store", "product_name")


@query("sort_found_first_whole", f"WITH {SHOPPING} SELECT plan_id, found, ingredient FROM shopping", V)
@query("sort_found_first", f"WITH {SHOPPING} SELECT plan_id, found, ingredient FROM shopping", V)
def sort_found_first(spark, d):
    return priced_list(spark, d).select("plan_id", "found", "ingredient").orderBy("plan_id", F.desc("found"), "ingredient")


STATS = f"""WITH {SHOPPING} SELECT plan_id, count(*) AS total_ingredients, count(*) FILTER (WHERE found) AS found_in_db,
    count(*) FILTER (WHERE NOT found) AS not_found, floor(CAST(coalesce(sum(CAST(cost AS DECIMAL(18,2))) FILTER (WHERE found), 0) AS DOUBLE) * 100 + 0.5) / 100 AS estimated_cost,
    CAST(floor(CAST(count(*) FILTER (WHERE found) AS DOUBLE) / count(*) * 100 + 0.5) AS BIGINT) AS coverage_percent FROM shopping GROUP BY plan_id"""


@query("agg_shopping_stats_whole", STATS, V)
@query("agg_shopping_stats", STATS, V)
def agg_shopping_stats(spark, d):
    return mealplan.shopping_stats(priced_list(spark, d))


ADJ = ["hot", "red", "new", "blue", "large", "small", "cold", "zzz"]
NOUN = ["gear", "bolt", "plate", "anvil", "rod", "gizmo", "ring", "qqq"]
sql_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
MEALS = f"""meals AS (SELECT o_orderkey AS meal_id, o_orderkey % 2 = 1 AS has_snacks,
    [CAST(o_orderkey % 40 * 10 AS VARCHAR) || 'g ' || {sql_list(ADJ)}[o_orderkey % 8 + 1] || ' ' || {sql_list(NOUN)}[o_orderkey // 8 % 8 + 1] || ' (x)',
     {sql_list(ADJ)}[o_custkey % 8 + 1] || ' ' || {sql_list(NOUN)}[o_custkey // 8 % 8 + 1]] AS ing FROM orders),
  lines AS (SELECT meal_id, 0 AS pos, ing[1] AS raw FROM meals UNION ALL SELECT meal_id, 1, ing[2] FROM meals),
  cleaned AS (SELECT meal_id, pos, raw, {CLEAN} AS ingredient, TRY_CAST(regexp_extract(raw, '([0-9]+)g', 1) AS BIGINT) AS grams FROM lines),
  tiers AS (SELECT ingredient, 1 AS tier, string_split(ingredient, ' ') AS terms FROM (SELECT DISTINCT ingredient FROM cleaned) c
    UNION ALL SELECT ingredient, 3, string_split(ingredient, ' ')[1:1] FROM (SELECT DISTINCT ingredient FROM cleaned) c
    UNION ALL SELECT ingredient, 4, string_split(ingredient, ' ')[2:2] FROM (SELECT DISTINCT ingredient FROM cleaned) c),
  prices AS (SELECT * FROM (SELECT t.ingredient, p.price, p.supermarket AS store, row_number() OVER (PARTITION BY t.ingredient ORDER BY t.tier, p.price, p.id) AS rn
    FROM tiers t JOIN v_products p ON len([x FOR x IN t.terms IF contains(p.normalized_name, x)]) = len(t.terms)) h WHERE rn = 1)"""


@query("join_plan_enrich", f"""WITH {MEALS}
  SELECT c.meal_id, CASE WHEN any_value(m.has_snacks) THEN 'apple' ELSE 'Φρούτο εποχής' END AS morning_snack, string_agg(c.raw || ':' || coalesce(p.store, '-') || ':' ||
    coalesce(CAST(CAST(floor((CASE WHEN coalesce(c.grams, 0) > 0 THEN least(floor(p.price * c.grams / 1000 * 100 + 0.5) / 100, p.price) ELSE p.price END) * 100 + 0.5) AS BIGINT) AS VARCHAR), '-'), '|' ORDER BY c.pos) AS ingredients
  FROM cleaned c JOIN meals m ON c.meal_id = m.meal_id LEFT JOIN prices p ON c.ingredient = p.ingredient GROUP BY c.meal_id""", ("v_products",))
def join_plan_enrich(spark, d):
    at = lambda xs, i: F.get(F.lit(xs), (i % 8).cast("int"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    meals = tables.table(spark, d, "orders").select(
        o.alias("meal_id"),
        F.when(o % 2 == 1, F.struct(F.lit("apple").alias("morning"), F.lit("nuts").alias("afternoon"))).alias("snacks"),
        F.array(
            F.concat((o % 40 * 10).cast("string"), F.lit("g "), at(ADJ, o), F.lit(" "), at(NOUN, F.floor(o / 8)), F.lit(" (x)")),
            F.concat(at(ADJ, c), F.lit(" "), at(NOUN, F.floor(c / 8))),
        ).alias("ingredients"))
    names = meals.select(F.explode("ingredients").alias("raw")).select(clean_ingredient_name("raw").alias("ingredient"))
    rich = mealplan.enrich_meals(meals, mealplan.best_prices(names, tables.products(spark, d)))
    text = F.transform("ingredients", lambda s: F.concat_ws(
        ":", s["name"], F.coalesce(s["store"], F.lit("-")), F.coalesce(F.floor(s["price"] * 100 + 0.5).cast("string"), F.lit("-"))))
    return rich.select("meal_id", F.col("snacks.morning").alias("morning_snack"), as_text(text).alias("ingredients"))


@query("strip_quantity", "SELECT order_key, line_number, raw, trim(regexp_replace(raw, '^[0-9]+g *', '')) AS name FROM v_ingredients", ("v_ingredients",))
def strip_quantity_(spark, d):
    return tables.ingredients(spark, d).select("order_key", "line_number", "raw", strip_quantity("raw").alias("name"))


@query("clean_ingredient_name", f"SELECT order_key, line_number, raw, {CLEAN} AS name FROM v_ingredients", ("v_ingredients",))
def clean_name(spark, d):
    return tables.ingredients(spark, d).select("order_key", "line_number", "raw", clean_ingredient_name("raw").alias("name"))


@query("extract_grams", "SELECT order_key, line_number, CAST(regexp_extract(raw, '([0-9]+)g', 1) AS INT) AS grams FROM v_ingredients", ("v_ingredients",))
def grams(spark, d):
    return tables.ingredients(spark, d).select("order_key", "line_number", extract_grams("raw").alias("grams"))


@query("ingredient_cost", """
    SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN g = 0 THEN l_extendedprice
      WHEN l_linenumber % 2 = 0 THEN floor(2.98 * CAST(g AS DOUBLE) / 1000 * 100 + 0.5) / 100
      ELSE least(floor(l_extendedprice * g / 1000 * 100 + 0.5) / 100, l_extendedprice) END AS cost
    FROM (SELECT *, CAST(l_quantity AS BIGINT) % 5 * 100 AS g FROM lineitem) t""")
def ingredient_cost(spark, d):
    line = tables.table(spark, d, "lineitem")
    unit = F.when(F.col("l_linenumber") % 2 == 0, "2,98€/κιλό")
    g = F.col("l_quantity").cast("bigint") % 5 * 100
    return line.select("l_orderkey", "l_linenumber", "l_quantity", nm.ingredient_cost("l_extendedprice", unit, g).alias("cost"))


KCAL = "CAST(floor(protein * 4 + carbs * 4 + fat * 9 + 0.5) AS BIGINT)"


@query("macro_kcal", f"SELECT day, slot, protein, carbs, fat, {KCAL} AS kcal FROM v_meals", ("v_meals",))
def macro_kcal(spark, d):
    return tables.meals(spark, d).select("day", "slot", "protein", "carbs", "fat", nm.macro_kcal("protein", "carbs", "fat").alias("kcal"))


DAYS = f"""SELECT day, CAST(sum(CASE WHEN ends_with(slot, '_alt') THEN 0 ELSE {KCAL} END) AS BIGINT) AS kcal,
    sum(CASE WHEN ends_with(slot, '_alt') THEN 0 ELSE protein END) AS protein, sum(CASE WHEN ends_with(slot, '_alt') THEN 0 ELSE carbs END) AS carbs,
    sum(CASE WHEN ends_with(slot, '_alt') THEN 0 ELSE fat END) AS fat FROM v_meals GROUP BY day"""


@query("agg_day_macros", DAYS, ("v_meals",))
def agg_day_macros(spark, d):
    return mealplan.day_macros(tables.meals(spark, d), ["day"])


@query("agg_plan_summary", f"""
    WITH days AS ({DAYS}), s AS (SELECT day % 50 AS plan_id, count(*) AS n, sum(kcal) AS kcal, sum(protein) AS protein, sum(carbs) AS carbs, sum(fat) AS fat FROM days GROUP BY 1)
    SELECT plan_id, CAST(floor(CAST(kcal AS DOUBLE) / n + 0.5) AS BIGINT) AS avg_kcal_per_day,
      CAST(floor(protein / n * 4 / (CAST(kcal AS DOUBLE) / n) * 100 + 0.5) AS BIGINT) AS protein_pct, CAST(floor(carbs / n * 4 / (CAST(kcal AS DOUBLE) / n) * 100 + 0.5) AS BIGINT) AS carbs_pct,
      CAST(floor(fat / n * 9 / (CAST(kcal AS DOUBLE) / n) * 100 + 0.5) AS BIGINT) AS fat_pct FROM s""", ("v_meals",))
def agg_plan_summary(spark, d):
    days = mealplan.day_macros(tables.meals(spark, d), ["day"]).withColumn("plan_id", F.col("day") % 50)
    return mealplan.plan_summary(days, "plan_id")


@query("macro_ratio_normalise", """
    WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, coalesce(nullif(l_partkey % 4, 0), 30) AS p, coalesce(nullif(l_suppkey % 5, 0), 40) AS c, coalesce(nullif(CAST(l_quantity AS BIGINT) % 3, 0), 30) AS f FROM lineitem),
    r AS (SELECT *, CAST(floor(p / (p + c + f) * 100 + 0.5) AS BIGINT) AS pp, CAST(floor(c / (p + c + f) * 100 + 0.5) AS BIGINT) AS cp, CAST(floor(f / (p + c + f) * 100 + 0.5) AS BIGINT) AS fp FROM t)
    SELECT l_orderkey, l_linenumber, l_quantity, pp AS protein_pct, cp + 100 - pp - cp - fp AS carbs_pct, fp AS fat_pct FROM r""")
def macro_ratio(spark, d):
    line = tables.table(spark, d, "lineitem")
    p, c, f = nm.macro_ratio(F.col("l_partkey") % 4, F.col("l_suppkey") % 5, F.col("l_quantity").cast("bigint") % 3)
    return line.select("l_orderkey", "l_linenumber", "l_quantity", p.alias("protein_pct"), c.alias("carbs_pct"), f.alias("fat_pct"))


@query("macro_targets", """
    WITH t AS (SELECT c_custkey, coalesce(nullif(c_custkey % 3000, 0), 1800) AS k FROM customer),
    g AS (SELECT *, floor(floor(k * 30 / 100 + 0.5) / 4 + 0.5) AS p, floor(floor(k * 40 / 100 + 0.5) / 4 + 0.5) AS c, floor(floor(k * 30 / 100 + 0.5) / 9 + 0.5) AS f FROM t)
    SELECT c_custkey, slot, CAST(floor(k * share + 0.5) AS BIGINT) AS kcal, CAST(floor(p * share + 0.5) AS BIGINT) AS protein, CAST(floor(c * share + 0.5) AS BIGINT) AS carbs, CAST(floor(f * share + 0.5) AS BIGINT) AS fat
    FROM g, (VALUES ('breakfast', CAST(0.25 AS DOUBLE)), ('lunch', CAST(0.4 AS DOUBLE)), ('dinner', CAST(0.35 AS DOUBLE))) s(slot, share)""")
def macro_targets(spark, d):
    k = F.coalesce(nm.falsy_to_null(F.col("c_custkey") % 3000), F.lit(1800))
    p, c, f = nm.daily_grams(F.col("c_custkey") % 3000, 30, 40, 30)
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(w).alias("share")) for s, w in nm.SLOT_SHARES])
    day = tables.table(spark, d, "customer").select("c_custkey", k.alias("k"), p.alias("p"), c.alias("c"), f.alias("f"), F.inline(slots))
    part = lambda col, name: nm.js_round(F.col(col) * F.col("share")).alias(name)
    return day.select("c_custkey", "slot", part("k", "kcal"), part("p", "protein"), part("c", "carbs"), part("f", "fat"))


# --- nutrition and plate scans ----------------------------------------------

PIVOT = lambda keys: f"""SELECT {keys}, {', '.join(f"floor(min_by(value, pos) FILTER (WHERE nutrient_id = {i}) * 10 + 0.5) / 10 AS {f}" for i, f in
    ((1008, 'kcal'), (1003, 'proteins'), (1004, 'fat'), (1005, 'carbs'), (2000, 'sugars'), (1079, 'fiber'), (1093, 'sodium')))} FROM v_nutrients GROUP BY {keys}"""


@query("agg_nutrient_pivot", f"SELECT *, floor(sodium * 2.5 * 10 + 0.5) / 10 AS salt FROM ({PIVOT('food_id')}) p", ("v_nutrients",))
def agg_nutrient_pivot(spark, d):
    return nutrition.nutrient_pivot(tables.nutrients(spark, d), ["food_id"]).drop("saturated", "cholesterol")


@query("salt_from_sodium", "SELECT food_id, source_rank, value, floor(value * 2.5 * 10 + 0.5) / 10 AS salt FROM v_nutrients WHERE nutrient_id = 1093", ("v_nutrients",))
def salt(spark, d):
    return tables.nutrients(spark, d).where("nutrient_id = 1093").select("food_id", "source_rank", "value", nm.salt_from_sodium("value").alias("salt"))


@query("agg_best_source", f"""
    SELECT food_id, source_rank, filled, kcal FROM (SELECT *, row_number() OVER (PARTITION BY food_id ORDER BY filled DESC, source_rank) AS rn FROM
      (SELECT *, CAST(kcal IS NOT NULL AS INT) + CAST(fat IS NOT NULL AS INT) + CAST(proteins IS NOT NULL AS INT) + CAST(carbs IS NOT NULL AS INT)
        + CAST(sugars IS NOT NULL AS INT) + CAST(fiber IS NOT NULL AS INT) AS filled FROM ({PIVOT('food_id, source_rank')}) p) q) r WHERE rn = 1""", ("v_nutrients",))
def agg_best_source(spark, d):
    records = nutrition.nutrient_pivot(tables.nutrients(spark, d), ["food_id", "source_rank"])
    return nutrition.best_source(records, "food_id", "source_rank").select("food_id", "source_rank", "filled", "kcal")


@query("join_gtin_or_first", """
    SELECT request_id, gtin, matched FROM (SELECT l_partkey AS request_id, gtin, ltrim(gtin, '0') = CAST(l_partkey AS VARCHAR) AS matched,
      row_number() OVER (PARTITION BY l_partkey ORDER BY ltrim(gtin, '0') = CAST(l_partkey AS VARCHAR) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS rn
      FROM (SELECT *, CASE WHEN l_linenumber = 3 AND l_partkey % 2 = 0 THEN '0' || l_partkey ELSE 'x' || l_orderkey END AS gtin FROM lineitem) t) u WHERE rn = 1 AND request_id > 0""")
def join_gtin_or_first(spark, d):
    k = F.col("l_partkey")
    found = tables.table(spark, d, "lineitem").select(
        k.alias("request_id"), F.struct(*LINE_ORDER).alias("pos"),
        F.when((F.col("l_linenumber") == 3) & (k % 2 == 0), F.concat(F.lit("0"), k.cast("string")))
        .otherwise(F.concat(F.lit("x"), F.col("l_orderkey").cast("string"))).alias("gtin"))
    asked = tables.table(spark, d, "part").where("p_partkey > 0").select(
        F.col("p_partkey").alias("request_id"), F.concat(F.lit("00"), F.col("p_partkey").cast("string")).alias("barcode"))
    return nutrition.gtin_or_first(asked, found).select("request_id", "gtin", "matched")


FOODS = """SELECT l_orderkey AS scan_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS pos,
    CASE l_partkey % 4 WHEN 0 THEN 'Rice' WHEN 1 THEN 'rice' WHEN 2 THEN 'Egg pie' ELSE 'EGG PIE' END AS name,
    CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber || ' cups' ELSE '—' END AS portion, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 7 END AS calories,
    CAST(l_quantity AS BIGINT) AS protein, l_partkey % 60 AS carbs, l_suppkey % 30 AS fat, l_partkey % 9 AS sugar, l_suppkey % 7 AS fiber FROM lineitem"""
MERGED = f"""SELECT scan_id, lower(name) AS food_key, min_by(name, pos) AS name, coalesce(min_by(portion, pos) FILTER (WHERE portion <> '—'), '—') AS portion,
    CAST(sum(coalesce(nullif(calories, 0), protein * 4 + carbs * 4 + fat * 9)) AS BIGINT) AS calories, CAST(sum(protein) AS BIGINT) AS protein, CAST(sum(carbs) AS BIGINT) AS carbs,
    CAST(sum(fat) AS BIGINT) AS fat, CAST(sum(sugar) AS BIGINT) AS sugar, CAST(sum(fiber) AS BIGINT) AS fiber FROM ({FOODS}) f GROUP BY 1, 2"""


def merged_foods(spark, d):
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    foods = tables.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"), F.struct(*LINE_ORDER).alias("pos"),
        F.get(F.lit(["Rice", " rice ", "Egg  pie", "EGG PIE"]), (k % 4).cast("int")).alias("name"),
        F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(" cups"))).alias("portion"),
        F.when(k % 3 == 0, "x").otherwise((F.col("l_quantity").cast("bigint") * 7).cast("string")).alias("calories"),
        F.col("l_quantity").cast("bigint").alias("protein"), (k % 60).alias("carbs"), (s % 30).alias("fat"), (k % 9).alias("sugar"), (s % 7).alias("fiber"))
    return nutrition.merge_foods(foods)


@query("agg_merge_duplicate_foods", MERGED)
def agg_merge_duplicate_foods(spark, d):
    merged = merged_foods(spark, d)
    return merged.withColumn("name", F.replace("name", F.lit("  "), F.lit(" ")))


@query("sort_by_calories", f"SELECT scan_id, food_key, calories FROM ({MERGED}) m")
def sort_by_calories(spark, d):
    return merged_foods(spark, d).select("scan_id", "food_key", "calories").orderBy("scan_id", F.desc("calories"), "food_key")


@query("agg_reconcile_totals", """
    WITH c AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey, o_orderkey % 260 AS stated FROM orders)
    SELECT o_orderkey AS scan_id, CAST(CASE WHEN stated <> 0 AND abs(stated - total) <= greatest(15, floor(total * CAST(0.15 AS DOUBLE) + 0.5)) THEN stated ELSE total END AS BIGINT) AS protein
    FROM s JOIN c ON o_orderkey = l_orderkey""")
def agg_reconcile_totals(spark, d):
    computed = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("protein"))
    stated = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), (F.col("o_orderkey") % 260).alias("protein"))
    return nutrition.reconcile_totals(stated, computed, "scan_id", ["protein"])


@query("scan_history_context", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    f AS (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2)
    SELECT t.user_id, t.scan_count, r.recent AS recent_foods, f.freq AS frequent_foods FROM (SELECT user_id, least(count(*), 100) AS scan_count FROM events GROUP BY 1) t
    JOIN (SELECT user_id, string_agg(event_type, '|' ORDER BY rn) AS recent FROM r WHERE rn <= 10 GROUP BY 1) r ON t.user_id = r.user_id
    JOIN (SELECT user_id, string_agg(event_type, '|' ORDER BY rn) AS freq FROM f WHERE rn <= 6 GROUP BY 1) f ON t.user_id = f.user_id""")
def scan_history_context(spark, d):
    scans = tables.table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("id"), F.col("event_type").alias("food"))
    h = nutrition.scan_history(scans)
    return h.select("user_id", "scan_count", as_text("recent_foods").alias("recent_foods"), as_text("frequent_foods").alias("frequent_foods"))
