"""Aggregations, per-group ordering, sorts, limits and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import structures as st
from larder.functions.dates import epoch_micros
from larder.functions.text import as_text
from larder.operators import social
from larder.operators.ordering import Pages, batches, is_blank, reassemble, sorted_by
from larder.operators.scaling import add_kept, keep_first, top_k
from larder.plans.joins import ACCESS, VISIBLE, access, room_requests
from larder.plans.registry import query
from larder.sources import html, tables


@query("agg_count_by_category", """
    SELECT 'category' AS kind, lang AS label, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'cuisine', source, count(*) FROM documents GROUP BY source
    UNION ALL SELECT 'total', 'all', count(*) FROM documents""")
def agg_count_by_category(spark, d):
    """Counts per category, per cuisine and overall from one scan (grouping sets)."""
    docs = tables.table(spark, d, "documents").select("lang", "source")
    g = docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "cuisine").otherwise("total")
    return g.select(kind.alias("kind"), F.coalesce("lang", "source", F.lit("all")).alias("label"), "n")


@query("sort_group_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def sort_group_count(spark, d):
    return tables.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("agg_source_summary", """
    SELECT source_api, CASE source_api WHEN 'src0' THEN 'API' ELSE source_api END AS label, count(*) AS n, epoch_us(max(created_at)) AS latest_us FROM v_recipes GROUP BY 1""", ("v_recipes",))
def agg_source_summary(spark, d):
    r = tables.recipes(spark, d).groupBy("source_api").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))
    label = F.coalesce(F.try_element_at(st.label_map({"src0": "API"}), F.col("source_api")), F.col("source_api"))
    return r.select("source_api", label.alias("label"), "n", epoch_micros("latest").alias("latest_us")).orderBy(F.desc("n"), "source_api")


@query("agg_scrape_status", "SELECT count(*) AS total, epoch_us(max(date_scraped)) AS latest_us FROM v_offers WHERE price > 0", ("v_offers",))
def agg_scrape_status(spark, d):
    o = tables.offers(spark, d).where("price > 0").agg(F.count("*").alias("total"), F.max("date_scraped").alias("latest"))
    return o.select("total", epoch_micros("latest").alias("latest_us"))


@query("sort_page", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 100")
def sort_page(spark, d):
    part = tables.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return Pages(part, [F.desc("p_retailprice"), "p_partkey"], 50).page(3)


@query("agg_page_total", """SELECT p.p_partkey, t.total, CAST(ceil(t.total / 20.0) AS BIGINT) AS pages FROM
    (SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 20 OFFSET 20) p, (SELECT count(*) AS total FROM part) t""")
def agg_page_total(spark, d):
    pages = Pages(tables.table(spark, d, "part").select("p_partkey", "p_size"), ["p_size", "p_partkey"], 20)
    one = lambda c: pages.totals().select(c).scalar().alias(c)
    return pages.page(2).select("p_partkey", one("total"), one("pages"))


@query("sort_every_page", """
    SELECT p_partkey, p_retailprice, (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) // 50 + 1 AS page,
      (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) % 50 AS place FROM part""")
def sort_every_page(spark, d):
    """Every page of the product list from one job."""
    part = tables.table(spark, d, "part").select("p_partkey", "p_retailprice")
    return Pages(part, [F.desc("p_retailprice"), "p_partkey"], 50).all()


@query("limit_with_full_total", """SELECT p.p_partkey, t.total FROM (SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 30) p,
    (SELECT count(*) AS total FROM part WHERE p_size > 10) t""")
def limit_with_full_total(spark, d):
    part = tables.table(spark, d, "part").where("p_size > 10").select("p_partkey")
    return part.orderBy("p_partkey").limit(30).withColumn("total", part.agg(F.count("*").alias("n")).scalar())


@query("agg_list_quota", f"""
    SELECT a.id AS user_id, count(l.list_id) AS n_lists, CASE WHEN a.is_premium THEN 10 ELSE 2 END AS list_limit,
      count(l.list_id) >= CASE WHEN a.is_premium THEN 10 ELSE 2 END AS full_up FROM ({ACCESS}) a LEFT JOIN v_lists l ON l.user_id = a.id GROUP BY a.id, a.is_premium""", ("v_users", "v_lists"))
def agg_list_quota(spark, d):
    n = tables.lists(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_lists"))
    q = social.list_quota(access(spark, d)).join(n, "id", "left").withColumn("n_lists", F.coalesce("n_lists", F.lit(0)))
    return q.select(F.col("id").alias("user_id"), "n_lists", "list_limit", (F.col("n_lists") >= F.col("list_limit")).alias("full_up"))


CONTRACTS = [("items", "li", 3), ("links", "a[href]", 3), ("images", "img", 3)]


@query("agg_selector_contract", """
    WITH c AS (SELECT page_id, 'items' AS "check", len(regexp_extract_all(html, '<li>')) AS got FROM pages UNION ALL
      SELECT page_id, 'links', len(regexp_extract_all(html, '<a href=')) FROM pages UNION ALL SELECT page_id, 'images', len(regexp_extract_all(html, '<img')) FROM pages)
    SELECT "check", count(*) FILTER (WHERE got >= 3) AS passed, count(*) FILTER (WHERE got < 3) AS failed FROM c GROUP BY 1""")
def agg_selector_contract(spark, d):
    counts = html.contract_counts(tables.table(spark, d, "pages"), CONTRACTS)
    ok = F.col("got") >= F.col("expected")
    return counts.groupBy("check").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


@query("agg_outcome_counts", """
    WITH o AS (SELECT source, CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'skipped' ELSE 'added' END AS outcome FROM documents)
    SELECT coalesce(source, 'all') AS source, count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
      count(*) FILTER (WHERE outcome = 'error') AS errors FROM o GROUP BY ROLLUP (source)""")
def agg_outcome_counts(spark, d):
    k = F.col("doc_id") % 5
    o = tables.table(spark, d, "documents").select("source", F.when(k == 0, "error").when(k == 1, "skipped").otherwise("added").alias("outcome"))
    n = lambda name: F.count_if(F.col("outcome") == name)
    r = o.rollup("source").agg(n("added").alias("added"), n("skipped").alias("skipped"), n("error").alias("errors"))
    return r.withColumn("source", F.coalesce("source", F.lit("all")))


@query("agg_distinct_tags", "SELECT id, category || '|' || source_api AS tags FROM v_recipes", ("v_recipes",))
def agg_distinct_tags(spark, d):
    r = tables.recipes(spark, d)
    return r.select("id", as_text(F.array_distinct(F.concat("tags", F.array("category"), "tags"))).alias("tags"))


# --- per-group ordering -------------------------------------------------------

@query("win_first_wins", "SELECT product_id, order_key, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY pos) AS rn FROM v_offers) t WHERE rn = 1", ("v_offers",))
def win_first_wins(spark, d):
    return keep_first(tables.offers(spark, d), ["product_id"], ["pos"]).select("product_id", "order_key", "price")


@query("win_last_wins", "SELECT product_id, order_key, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY pos DESC) AS rn FROM v_offers) t WHERE rn = 1", ("v_offers",))
def win_last_wins(spark, d):
    return keep_first(tables.offers(spark, d), ["product_id"], [F.desc("pos")]).select("product_id", "order_key", "price")


@query("win_first_title_in_run", """
    SELECT id, source_api FROM (SELECT *, row_number() OVER (PARTITION BY source_api, lower(trim(title)) ORDER BY id) AS rn FROM v_recipes) t WHERE rn = 1""", ("v_recipes",))
def win_first_title_in_run(spark, d):
    r = tables.recipes(spark, d).select("id", "source_api", F.lower(F.trim("title")).alias("t"))
    return keep_first(r, ["source_api", "t"], ["id"]).select("id", "source_api")


@query("win_top_n_per_area", f"""
    SELECT area, s_suppkey, s_name FROM (SELECT n_name AS area, s.*, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS rn
      FROM supplier s JOIN nation n ON s_nationkey = n_nationkey WHERE n_nationkey IN (1, 3, 5, 7, 9)) t WHERE rn <= 8""")
def win_top_n_per_area(spark, d):
    n = tables.table(spark, d, "nation").where(F.col("n_nationkey").isin(1, 3, 5, 7, 9)).select("n_nationkey", F.col("n_name").alias("area"))
    s = tables.table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    return top_k(s.join(n, "n_nationkey"), ["n_nationkey"], ["s_suppkey"], 8).select("area", "s_suppkey", "s_name")


@query("win_list_admission", f"""
    SELECT list_id, user_id, rn FROM (SELECT l.*, a.is_premium, row_number() OVER (PARTITION BY user_id ORDER BY created_at, list_id) AS rn
      FROM v_lists l JOIN ({ACCESS}) a ON l.user_id = a.id) t WHERE rn <= CASE WHEN is_premium THEN 10 ELSE 2 END""", ("v_users", "v_lists"))
def win_list_admission(spark, d):
    """Lists accepted while their owner is under the limit (no deletes)."""
    first = top_k(tables.lists(spark, d), ["user_id"], ["created_at", "list_id"], 10, rank="rn")
    quota = social.list_quota(access(spark, d)).select(F.col("id").alias("user_id"), "list_limit")
    return first.join(quota, "user_id").where("rn <= list_limit").select("list_id", "user_id", "rn")


@query("win_latest_per_user", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1")
def win_latest_per_user(spark, d):
    e = tables.table(spark, d, "events").select("user_id", "event_id", "ts")
    return keep_first(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


NONBLANK = "SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS j FROM v_lines WHERE trim(line) <> ''"


@query("win_batch_number", f"SELECT doc_id, pos, j // 50 AS batch FROM ({NONBLANK}) t", ("v_lines",))
def win_batch_number(spark, d):
    """Texts of one recipe numbered into batches of 50, inside the row (no shuffle)."""
    docs = tables.table(spark, d, "documents").select("doc_id", F.inline(batches(F.split("text", "\n", -1))))
    return docs.select("doc_id", F.col("i").cast("bigint").alias("pos"), "batch")


@query("win_position_reassembly", f"""
    WITH n AS ({NONBLANK}), k AS (SELECT doc_id, count(*) AS n FROM n GROUP BY 1)
    SELECT l.doc_id, l.pos, CASE WHEN n.j IS NULL THEN l.line WHEN n.j >= 3 THEN l.line ELSE 'T' || lower(n.line) END AS line
    FROM v_lines l LEFT JOIN n ON l.doc_id = n.doc_id AND l.pos = n.pos""", ("v_lines",))
def win_position_reassembly(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    three = F.slice(F.filter("ls", lambda x: ~is_blank(x)), 1, 3)  # only the first three came back
    results = F.transform(three, lambda x: F.concat(F.lit("T"), F.lower(x)))
    return docs.select("doc_id", F.posexplode(reassemble(F.col("ls"), results)).alias("p", "line")).select("doc_id", F.col("p").cast("bigint").alias("pos"), "line")


# --- sorts and limits -----------------------------------------------------------

MODE_SQL = {"newest": "created_at DESC NULLS LAST", "quick": "minutes NULLS FIRST", "protein": "protein DESC NULLS LAST", "calories": "calories NULLS FIRST",
            "popular": "protein DESC NULLS LAST, calories NULLS FIRST", "other": "created_at DESC NULLS LAST"}


@query("sort_mode", " UNION ALL ".join(f"SELECT '{m}' AS mode, id FROM (SELECT id FROM v_recipes ORDER BY {o}, id LIMIT 10) t_{m}" for m, o in MODE_SQL.items()), ("v_recipes",))
def sort_mode(spark, d):
    r = tables.recipes(spark, d)
    out = None
    for mode in MODE_SQL:
        one = sorted_by(r, mode).limit(10).select(F.lit(mode).alias("mode"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("topk_cheapest", "SELECT p_type, rn, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS rn FROM part) t WHERE rn <= 3")
def topk_cheapest(spark, d):
    part = tables.table(spark, d, "part").select("p_type", "p_partkey", "p_retailprice")
    return top_k(part, ["p_type"], ["p_retailprice", "p_partkey"], 3, rank="rn")


@query("sort_recent_first", "SELECT list_id, user_id, epoch_us(created_at) AS created_us FROM v_lists", ("v_lists",))
def sort_recent_first(spark, d):
    ls = tables.lists(spark, d).select("list_id", "user_id", epoch_micros("created_at").alias("created_us"))
    return ls.orderBy("user_id", F.desc("created_us"), "list_id")


@query("topk_oldest_messages", f"""
    SELECT request_id, id, rn FROM (SELECT v.request_id, v.id, row_number() OVER (PARTITION BY v.request_id ORDER BY m.created_at, v.id) AS rn FROM ({VISIBLE}) v
      JOIN v_messages m ON v.id = m.id) t WHERE rn <= 100""", ("v_messages",))
def topk_oldest_messages(spark, d):
    """The oldest 100 visible messages of each request; each room is cut to 100 before the join."""
    return social.oldest_of_keys(tables.messages(spark, d), social.wanted_keys(room_requests(spark, d)), 100)


@query("topk_labels", """
    WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS s FROM embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS rn FROM e WHERE s > CAST(0.05 AS DOUBLE))
    SELECT vec_id, string_agg(i || ':' || CAST(floor(s * 100 + 0.5) AS BIGINT), '|' ORDER BY i) AS labels FROM k WHERE rn <= 5 GROUP BY vec_id""")
def topk_labels(spark, d):
    scored = F.transform("embedding", lambda s, i: F.struct(i.cast("string").alias("label"), s.cast("double").alias("score")))
    e = add_kept(tables.table(spark, d, "embeddings"), "ls", st.top_labels(scored), lambda ls: F.size(ls) > 0)
    return e.select("vec_id", as_text(F.transform("ls", lambda x: F.concat(x["label"], F.lit(":"), x["score"].cast("string")))).alias("labels"))


@query("union_all_sources", "SELECT 'supplier' AS origin, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_name FROM customer")
def union_all_sources(spark, d):
    s = tables.table(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name"))
    return s.unionByName(tables.table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name")))
