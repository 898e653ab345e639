"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import structures as st
from larder.functions.dates import epoch_micros
from larder.functions.text import url_to_store
from larder.operators import filters as flt
from larder.plans.registry import query
from larder.sources import tables


@query("project_columns", "SELECT p_partkey, p_name, p_retailprice FROM part")
def project_columns(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")


@query("friend_list", """
    SELECT e.a AS id, u.share_key, u.name AS username, epoch_us(u.trial_ends_at) AS added_us
    FROM v_edges e JOIN v_users u ON e.b = u.id""", ("v_edges", "v_users"))
def friend_list(spark, d):
    """Nested friends array of each user to rows."""
    u = tables.users(spark, d)
    friend = u.select(F.col("id").alias("b"), F.array(F.struct(
        "share_key", F.col("name").alias("username"), F.col("trial_ends_at").alias("added_at"))).alias("friends"))
    stored = tables.edges(spark, d).join(friend, "b").select(F.col("a").alias("id"), "friends")
    return stored.select("id", F.inline("friends")).select("id", "share_key", "username", epoch_micros("added_at").alias("added_us"))


FAVORITES = """SELECT list_id AS favorite_id, user_id, CASE WHEN list_id % 2 = 0 THEN CAST(list_id AS VARCHAR) END AS mealdb_id,
    CASE WHEN list_id % 2 = 1 THEN CAST(list_id % 1000 AS VARCHAR) END AS recipe_id, title, total, created_at FROM v_lists"""


def favorites(spark, d):
    """Favourites with a nested recipe snapshot."""
    i = F.col("list_id")
    return tables.lists(spark, d).select(
        i.alias("favorite_id"), "user_id", F.when(i % 2 == 0, i.cast("string")).alias("mealdb_id"),
        F.when(i % 2 == 1, (i % 1000).cast("string")).alias("recipe_id"),
        F.struct("title", "total").alias("recipe"), F.col("created_at").alias("added_at"))


@query("favorite_projection", f"""
    SELECT coalesce('mealdb_' || mealdb_id, recipe_id) AS id, favorite_id, mealdb_id, epoch_us(created_at) AS added_us, title, total
    FROM ({FAVORITES}) f""", ("v_lists",))
def favorite_projection(spark, d):
    """Public id, and the snapshot's fields spliced to the top level."""
    return favorites(spark, d).select(
        F.coalesce(F.concat(F.lit("mealdb_"), "mealdb_id"), F.col("recipe_id")).alias("id"),
        "favorite_id", "mealdb_id", epoch_micros("added_at").alias("added_us"), "recipe.*")


@query("favorite_id_split", f"""
    SELECT user_id, CASE WHEN recipe_id IS NOT NULL THEN 'recipe' ELSE 'mealdb' END AS kind, coalesce(recipe_id, mealdb_id) AS id,
           epoch_us(created_at) AS added_us FROM ({FAVORITES}) f""", ("v_lists",))
def favorite_id_split(spark, d):
    """The two id lists of every user, newest first, as sorted rows (a list may be any length)."""
    f = favorites(spark, d)
    return f.select(
        "user_id", F.when(F.col("recipe_id").isNotNull(), "recipe").otherwise("mealdb").alias("kind"),
        F.coalesce("recipe_id", "mealdb_id").alias("id"), epoch_micros("added_at").alias("added_us"),
    ).orderBy("user_id", "kind", F.desc("added_us"), "id")


SNAPSHOT_FIELDS = ["title", "description", "servings", "minutes", "calories", "protein", "carbs", "fat",
                   "ingredients", "instructions", "tags", "category", "source_api"]


@query("snapshot_projection", """
    SELECT id, title, servings, minutes, calories, protein, carbs, fat, len(ingredients) AS n_ingredients,
           len(instructions) AS n_instructions, tags[1] AS first_tag, category, source_api FROM v_recipes""", ("v_recipes",))
def snapshot_projection(spark, d):
    """Recipe fields copied into one nested snapshot."""
    snap = tables.recipes(spark, d).select("id", F.struct(*SNAPSHOT_FIELDS).alias("recipe"))
    r = lambda f: F.col(f"recipe.{f}")
    return snap.select("id", *[r(f) for f in ("title", "servings", "minutes", "calories", "protein", "carbs", "fat")],
                       F.size(r("ingredients")).cast("bigint").alias("n_ingredients"),
                       F.size(r("instructions")).cast("bigint").alias("n_instructions"),
                       F.get(r("tags"), 0).alias("first_tag"), r("category"), r("source_api"))


@query("filter_equality", "SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source = 'src2'")
def filter_equality(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", "lang", "source")
    return flt.where_equal(docs, lang="fr", source="src2", doc_id=flt.ALL)


@query("filter_by_id", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 17")
def filter_by_id(spark, d):
    return flt.where_equal(tables.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), doc_id=17)


@query("filter_array_contains", "SELECT id, category FROM v_recipes WHERE list_contains(tags, 'src3')", ("v_recipes",))
def filter_array_contains(spark, d):
    return tables.recipes(spark, d).where(F.array_contains("tags", "src3")).select("id", "category")


@query("filter_array_non_empty", "SELECT id FROM v_recipes WHERE len(ingredients) > 0", ("v_recipes",))
def filter_array_non_empty(spark, d):
    return tables.recipes(spark, d).where(F.size("ingredients") > 0).select("id")


@query("filter_not_null", "SELECT id, calories FROM v_recipes WHERE calories IS NOT NULL", ("v_recipes",))
def filter_not_null(spark, d):
    return tables.recipes(spark, d).where(F.col("calories").isNotNull()).select("id", "calories")


@query("filter_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def filter_positive(spark, d):
    return tables.table(spark, d, "customer").select("c_custkey", "c_acctbal").where("c_acctbal > 0")


@query("filter_regex_ci", "SELECT id, name FROM v_users WHERE contains(lower(name), 'r#00000001') OR contains(lower(email), 'r00000002')", ("v_users",))
def filter_regex_ci(spark, d):
    u = tables.users(spark, d)
    return u.where(flt.contains_ci(["name"], "R#00000001") | flt.contains_ci(["email"], "R00000002")).select("id", "name")


@query("filter_key_exact_ci", "SELECT id, name, share_key FROM v_users WHERE upper(trim(share_key)) = 'K000000042'", ("v_users",))
def filter_key_exact_ci(spark, d):
    return tables.users(spark, d).where(flt.same_key("share_key", F.lit(" k000000042 "))).select("id", "name", "share_key")


@query("filter_all_terms", "SELECT id, name, price FROM v_products WHERE contains(normalized_name, 'red') AND contains(normalized_name, 'widget')", ("v_products",))
def filter_all_terms(spark, d):
    return tables.products(spark, d).where(flt.all_terms("normalized_name", ["red", "widget"])).select("id", "name", "price")


@query("filter_in_list", """
    SELECT id, share_key FROM v_messages WHERE share_key IN (SELECT b % 40 FROM v_edges WHERE a % 5 = 0)""", ("v_messages", "v_edges"))
def filter_in_list(spark, d):
    keys = tables.edges(spark, d).where("a % 5 = 0").select((F.col("b") % 40).alias("share_key"))
    return tables.messages(spark, d).join(keys, "share_key", "left_semi").select("id", "share_key")


@query("filter_exclude_self", "SELECT id, name FROM v_users WHERE id <> 7", ("v_users",))
def filter_exclude_self(spark, d):
    return tables.users(spark, d).where(F.col("id") != 7).select("id", "name")


@query("filter_barcode_format", """
    SELECT p_partkey, CAST(p_partkey * 1237 AS VARCHAR) AS barcode FROM part
    WHERE regexp_full_match(CAST(p_partkey * 1237 AS VARCHAR), '[0-9]{6,14}')""")
def filter_barcode_format(spark, d):
    coded = tables.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 1237).cast("string").alias("barcode"))
    return coded.where(F.col("barcode").rlike(flt.BARCODE))


SIGNUPS = """SELECT id, CASE WHEN id % 11 = 0 THEN ' ' WHEN id % 7 = 0 THEN 'ab' ELSE name END AS name,
    CASE WHEN id % 5 = 0 THEN 'short' ELSE 'long enough' END AS password,
    CASE id % 4 WHEN 0 THEN replace(email, '@', '') WHEN 1 THEN ' ' || upper(email) ELSE email END AS email FROM v_users"""


def signups(spark, d):
    i = F.col("id")
    return tables.users(spark, d).select(
        "id", F.when(i % 11 == 0, " ").when(i % 7 == 0, "ab").otherwise(F.col("name")).alias("name"),
        F.when(i % 5 == 0, "short").otherwise("long enough").alias("password"),
        F.when(i % 4 == 0, F.replace("email", F.lit("@"), F.lit(""))).when(i % 4 == 1, F.concat(F.lit(" "), F.upper("email")))
        .otherwise(F.col("email")).alias("email"))


@query("filter_email_format", f"""
    SELECT id, lower(trim(email)) AS email FROM ({SIGNUPS}) s WHERE regexp_matches(lower(trim(email)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{{2,}}$')""", ("v_users",))
def filter_email_format(spark, d):
    return signups(spark, d).where(flt.is_email("email")).select("id", F.lower(F.trim("email")).alias("email"))


@query("filter_registration_rules", f"""
    SELECT s.id, CASE WHEN trim(s.name) = '' THEN 'missing' WHEN length(trim(s.name)) NOT BETWEEN 3 AND 30 THEN 'name'
      WHEN length(password) < 6 THEN 'password' WHEN NOT contains(s.email, '@') THEN 'email'
      WHEN u.id IS NOT NULL THEN 'taken' ELSE 'ok' END AS outcome
    FROM ({SIGNUPS}) s LEFT JOIN v_users u ON u.email = lower(trim(s.email)) AND u.id % 3 = 0""", ("v_users",))
def filter_registration_rules(spark, d):
    known = tables.users(spark, d).where("id % 3 = 0").select(F.col("email").alias("clean"), F.lit(True).alias("used"))
    asked = signups(spark, d).withColumn("clean", F.lower(F.trim("email"))).join(known, "clean", "left")
    return asked.select("id", flt.registration_outcome("name", "password", "email", F.col("used").isNotNull()).alias("outcome"))


@query("filter_url_pattern", """
    SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]+') AND contains(url, 'example') AND NOT contains(url, '?page=')
      AND NOT ends_with(url, '#top')""")
def filter_url_pattern(spark, d):
    url = F.col("url")
    keep = url.rlike("/(en|fr)/\\d+") & url.contains("example") & ~url.contains("?page=") & ~url.endswith("#top")
    return tables.table(spark, d, "pages").select("page_id", "url").where(keep)


# Stand-in domain table for the stored pages.
PAGE_DOMAINS = [(".com", "Store Com", "ab"), (".net", "Store Net", "net"), (".org", "Store Org", "org")]
DOMAIN_SQL = """CASE WHEN contains(url, '.com') THEN 'ab' WHEN contains(url, '.net') THEN 'net' WHEN contains(url, '.org') THEN 'org' END"""


def store_pages(spark, d):
    return tables.table(spark, d, "pages").select("page_id", url_to_store("url", PAGE_DOMAINS).alias("s")).where(
        F.col("s").isNotNull()).select("page_id", "s.store", "s.id")


@query("filter_target_store", f"""
    SELECT page_id, 'rest' AS target FROM pages WHERE {DOMAIN_SQL} <> 'ab' UNION ALL SELECT page_id, 'net' FROM pages WHERE {DOMAIN_SQL} = 'net'""")
def filter_target_store(spark, d):
    s = store_pages(spark, d)
    pick = lambda t: s.where(flt.target_store("store", "id", t)).select("page_id", F.lit(t).alias("target"))
    return pick("rest").unionByName(pick("net"))


@query("filter_in_stock", """
    SELECT event_id FROM v_api_json WHERE json_extract_string(payload, '$.stockAvailability.available') <> 'false'""", ("v_api_json",))
def filter_in_stock(spark, d):
    tile = tables.api_payloads(spark, d).select("event_id", st.parse_tile("payload").alias("t"))
    return tile.where(st.in_stock(F.col("t"))).select("event_id")


@query("filter_slow_or_failed", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'slow' END AS label FROM events
    WHERE event_type = 'error' OR CAST(floor(value * 4) AS INT) >= 500""")
def filter_slow_or_failed(spark, d):
    log = tables.table(spark, d, "events").select(
        "event_id", F.floor(F.col("value") * 4).cast("int").alias("ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))
    return log.select("event_id", flt.request_label("ms", "status").alias("label")).where("label IS NOT NULL")


@query("filter_active_offers", """
    SELECT order_key, product_id, store_id, price, discount_percent FROM v_offers WHERE is_on_sale AND price > 0 AND store_id = 3""", ("v_offers",))
def filter_active_offers(spark, d):
    o = tables.offers(spark, d).where("is_on_sale AND price > 0 AND store_id = 3")
    return o.select("order_key", "product_id", "store_id", "price", "discount_percent")


@query("filter_scraped_record", """
    SELECT id, CASE WHEN length(trim(title)) = 0 OR id % 10 = 0 THEN 'no title'
      WHEN len(ingredients) = 0 AND len(instructions) = 0 THEN 'no content' ELSE 'ok' END AS outcome FROM v_recipes""", ("v_recipes",))
def filter_scraped_record(spark, d):
    r = tables.recipes(spark, d).withColumn("title", F.when(F.col("id") % 10 != 0, F.col("title")))
    no_title = F.coalesce(F.trim("title"), F.lit("")) == ""
    no_content = (F.size("ingredients") <= 0) & (F.size("instructions") <= 0)
    return r.select("id", F.when(no_title, "no title").when(no_content, "no content").otherwise("ok").alias("outcome"))
