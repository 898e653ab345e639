"""Joins and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import structures as st
from larder.functions.dates import ntz
from larder.functions.text import url_canonical
from larder.operators import graph, social
from larder.plans.registry import query
from larder.session import cut_lineage
from larder.sources import tables

NOW = "2024-01-31 00:00:00"


@query("join_favorite_snapshot", """
    SELECT l.list_id, l.user_id, r.id AS recipe_id, r.title, r.category FROM v_lists l JOIN v_users u ON l.user_id = u.id
    JOIN v_recipes r ON r.id = l.list_id % 2000""", ("v_lists", "v_users", "v_recipes"))
def join_favorite_snapshot(spark, d):
    """Favourite requests with the recipe they name; requests for an unknown recipe drop out."""
    asked = tables.lists(spark, d).select("list_id", "user_id", (F.col("list_id") % 2000).alias("recipe_id"))
    known = asked.join(tables.users(spark, d).select(F.col("id").alias("user_id")), "user_id", "left_semi")
    r = tables.recipes(spark, d).select(F.col("id").alias("recipe_id"), "title", "category")
    return known.join(r, "recipe_id").select("list_id", "user_id", "recipe_id", "title", "category")


ACCESS = f"""SELECT id, is_premium OR trial_ends_at > TIMESTAMP '{NOW}' AS is_premium, is_premium AS is_real_premium,
    NOT is_premium AND trial_ends_at > TIMESTAMP '{NOW}' AS is_on_trial,
    CASE WHEN NOT is_premium AND trial_ends_at > TIMESTAMP '{NOW}' THEN CAST(ceil((epoch_us(trial_ends_at) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000) AS BIGINT) ELSE 0 END AS trial_days_left FROM v_users"""


def access(spark, d):
    return social.access_state(tables.users(spark, d), ntz(NOW)).drop("trial_ends_at")


@query("join_user_access", f"""
    SELECT l.list_id, a.id IS NOT NULL AS known, a.is_premium, a.is_on_trial, a.trial_days_left FROM v_lists l LEFT JOIN ({ACCESS}) a
    ON a.id = CASE WHEN l.list_id % 10 = 0 THEN -1 ELSE l.user_id END""", ("v_lists", "v_users"))
def join_user_access(spark, d):
    asked = tables.lists(spark, d).select("list_id", F.when(F.col("list_id") % 10 == 0, -1).otherwise(F.col("user_id")).alias("id"))
    j = asked.join(access(spark, d).withColumn("hit", F.lit(True)), "id", "left")
    return j.select("list_id", F.col("hit").isNotNull().alias("known"), "is_premium", "is_on_trial", "trial_days_left")


LANGS = {"en": "Αγγλικά", "fr": "Γαλλικά", "es": "Ισπανικά"}


@query("join_dictionary", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'Αγγλικά' WHEN 'fr' THEN 'Γαλλικά' WHEN 'es' THEN 'Ισπανικά' ELSE lang END AS label FROM documents""")
def join_dictionary(spark, d):
    """Labels from a fixed map, the key itself where there is none."""
    docs = tables.table(spark, d, "documents").select("doc_id", "lang")
    return docs.select("doc_id", F.coalesce(F.try_element_at(st.label_map(LANGS), F.col("lang")), F.col("lang")).alias("label"))


VISIBLE = """WITH req AS (SELECT u * 1000 + k AS request_id, u AS own, (u + k) % 40 AS room FROM (SELECT DISTINCT share_key AS u FROM v_messages) s, (VALUES (0), (1), (5)) r(k))
    SELECT DISTINCT r.request_id, m.id FROM req r JOIN v_messages m ON (m.share_key = r.room AND m.target_key IS NULL)
      OR (m.share_key = r.own AND m.target_key = r.room) OR (m.target_key = r.own AND m.share_key = r.room)"""


def room_requests(spark, d):
    own = tables.messages(spark, d).select(F.col("share_key").alias("own")).distinct()
    return own.select("own", F.explode(F.lit([0, 1, 5])).alias("k")).select(
        (F.col("own") * 1000 + F.col("k")).alias("request_id"), "own", ((F.col("own") + F.col("k")) % 40).alias("room"))


def visible(spark, d):
    return social.visible_messages(tables.messages(spark, d), room_requests(spark, d))


@query("join_message_visibility", VISIBLE, ("v_messages",))
def join_message_visibility(spark, d):
    return visible(spark, d).select("request_id", "id")


MEMBERS = """SELECT u AS own, [(u + 1) % 40, (u + 5) % 40] AS friends FROM (SELECT DISTINCT share_key AS u FROM v_messages)"""


def members(spark, d):
    """Every chat key with its two friends."""
    own = tables.messages(spark, d).select(F.col("share_key").alias("own")).distinct()
    return own.select("own", F.array((F.col("own") + 1) % 40, (F.col("own") + 5) % 40).alias("friends"))


def text_keys(spark, d):
    text = lambda c: F.col(c).cast("string").alias(c)
    return tables.messages(spark, d).select("id", "created_at", text("share_key"), text("target_key"))


@query("group_message_history", f"""
    WITH u AS ({MEMBERS}), r AS (SELECT own * 10 + k AS request_id, own, friends, CASE k WHEN 0 THEN [own] WHEN 1 THEN list_append(friends, own) WHEN 2 THEN [friends[1], (own + 2) % 40] ELSE friends END AS rooms,
      k = 2 AND (own + 2) % 40 NOT IN (own, friends[1], friends[2]) AS refused FROM u, (VALUES (0), (1), (2), (3)) v(k)),
    v AS (SELECT request_id, m.id, row_number() OVER (PARTITION BY request_id ORDER BY m.created_at, m.id) AS rn FROM r JOIN v_messages m
      ON (list_contains(rooms, m.share_key) AND m.target_key IS NULL) OR (m.share_key = own AND list_contains(rooms, m.target_key)) OR (m.target_key = own AND list_contains(rooms, m.share_key)) WHERE NOT refused)
    SELECT request_id, false AS refused, id, rn FROM v WHERE rn <= 200 UNION ALL SELECT request_id, true, NULL, NULL FROM r WHERE refused""", ("v_messages",))
def group_message_history(spark, d):
    """Oldest 200 messages over all rooms of a request: without keys, own and friends, with a stranger's key, friends."""
    k = F.col("k")
    stranger = (F.col("own") + 2) % 40
    asked = F.when(k == 0, F.lit(None)).when(k == 1, F.array_append("friends", F.col("own"))).when(k == 2, F.array(F.get("friends", 0), stranger)).otherwise(F.col("friends"))
    requests = members(spark, d).select("own", "friends", F.explode(F.lit([0, 1, 2, 3])).alias("k")).select((F.col("own") * 10 + k).alias("request_id"), "own", "friends", asked.alias("keys"))
    return social.group_history(text_keys(spark, d), requests)


@query("own_room_history", f"""
    WITH u AS ({MEMBERS}), r AS (SELECT own * 10 + k AS request_id, own, list_append(friends, own) AS allowed, CASE k WHEN 0 THEN own WHEN 1 THEN friends[1] ELSE (own + 2) % 40 END AS room
      FROM u, (VALUES (0), (1), (2)) v(k)), g AS (SELECT *, list_contains(allowed, room) AS good FROM r),
    v AS (SELECT request_id, m.id, row_number() OVER (PARTITION BY request_id ORDER BY m.created_at, m.id) AS rn FROM g JOIN v_messages m
      ON (m.share_key = room AND m.target_key IS NULL) OR (room = own AND ((m.share_key = own AND list_contains(allowed, m.target_key)) OR (m.target_key = own AND list_contains(allowed, m.share_key))))
      OR (room <> own AND ((m.share_key = own AND m.target_key = room) OR (m.share_key = room AND m.target_key = own))) WHERE good)
    SELECT request_id, false AS refused, id, rn FROM v WHERE rn <= 100 UNION ALL SELECT request_id, true, NULL, NULL FROM g WHERE NOT good""", ("v_messages",))
def own_room_history(spark, d):
    """Oldest 100 messages of the own room with all friends, of a friend's room, and a stranger's room refused."""
    k = F.col("k")
    room = F.when(k == 0, F.col("own")).when(k == 1, F.get("friends", 0)).otherwise((F.col("own") + 2) % 40)
    requests = members(spark, d).select("own", "friends", F.explode(F.lit([0, 1, 2])).alias("k")).select((F.col("own") * 10 + k).alias("request_id"), "own", "friends", room.alias("room"))
    return social.room_history(text_keys(spark, d), requests)


KEYS = "'K' || lpad(CAST({0} AS VARCHAR), 9, '0')"


def key_rows(spark, d):
    key = lambda c: F.concat(F.lit("K"), F.lpad(c.cast("string"), 9, "0"))
    return tables.edges(spark, d).select(
        "a", "b", key(F.col("a")).alias("own"), F.array(key(F.col("b"))).alias("friends"),
        F.array(key(F.col("a")), key(F.col("b")), key(F.col("a") + 1)).alias("requested"))


@query("anti_unauthorised_keys", f"""SELECT a, CASE WHEN b = a + 1 THEN '' ELSE {KEYS.format('a + 1')} END AS invalid FROM v_edges""", ("v_edges",))
def anti_unauthorised_keys(spark, d):
    k = key_rows(spark, d)
    bad = F.array_except(F.slice("requested", 1, 25), social.allowed_keys(F.col("own"), F.col("friends")))
    return k.select("a", F.concat_ws("|", bad).alias("invalid"))


@query("set_allowed_keys", f"""SELECT a, {KEYS.format('a')} || '|' || {KEYS.format('b')} AS allowed FROM v_edges""", ("v_edges",))
def set_allowed_keys(spark, d):
    k = key_rows(spark, d)
    friends = F.concat(F.transform("friends", lambda x: F.concat(F.lit(" "), F.lower(x))), F.array(F.lit(""), F.col("own")))
    return k.select("a", F.concat_ws("|", social.allowed_keys(F.col("own"), friends)).alias("allowed"))


@query("anti_seen_url", """
    SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages WHERE page_id % 3 <> 0
    AND split_part(split_part(url, '#', 1), '?', 1) NOT IN (SELECT split_part(split_part(url, '#', 1), '?', 1) FROM pages WHERE page_id % 3 = 0)""")
def anti_seen_url(spark, d):
    p = tables.table(spark, d, "pages").select("page_id", url_canonical("url").alias("url"))
    return p.where("page_id % 3 <> 0").join(p.where("page_id % 3 = 0"), "url", "left_anti")


@query("anti_seen_title", """
    SELECT id, source_api FROM v_recipes WHERE id % 4 <> 0 AND (lower(title), source_api) NOT IN (SELECT lower(title), source_api FROM v_recipes WHERE id % 4 = 0)""", ("v_recipes",))
def anti_seen_title(spark, d):
    r = tables.recipes(spark, d).select("id", "source_api", F.lower("title").alias("t"))
    return r.where("id % 4 <> 0").join(r.where("id % 4 = 0"), ["t", "source_api"], "left_anti").select("id", "source_api")


@query("anti_untranslated_titles", "SELECT DISTINCT p_name AS title FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 7)")
def anti_untranslated_titles(spark, d):
    part = tables.table(spark, d, "part")
    cached = part.where("p_size = 7").select(F.col("p_name").alias("title"))
    return part.select(F.col("p_name").alias("title")).distinct().join(cached, "title", "left_anti")


@query("anti_stale_subscriptions", "SELECT event_id, endpoint FROM v_subs WHERE endpoint NOT IN (SELECT endpoint FROM v_subs WHERE failed AND event_id % 3 = 0)", ("v_subs",))
def anti_stale_subscriptions(spark, d):
    s = tables.subscriptions(spark, d)
    gone = s.where("failed AND event_id % 3 = 0").select("endpoint")
    return s.select("event_id", "endpoint").join(gone, "endpoint", "left_anti").select("event_id", "endpoint")


@query("join_push_audience", """
    SELECT s.event_id, p.payload FROM v_subs s JOIN (SELECT c_custkey AS user_id, 'offer for ' || c_name AS payload FROM customer WHERE c_custkey % 4 = 0) p ON s.user_id = p.user_id
    UNION ALL SELECT event_id, 'new deals' FROM v_subs""", ("v_subs",))
def join_push_audience(spark, d):
    """Notices to one user's endpoints, and one notice to every endpoint."""
    s = tables.subscriptions(spark, d).select("event_id", "user_id")
    notices = tables.table(spark, d, "customer").where("c_custkey % 4 = 0").select(
        F.col("c_custkey").alias("user_id"), F.concat(F.lit("offer for "), "c_name").alias("payload"))
    return s.join(notices, "user_id").select("event_id", "payload").unionByName(s.select("event_id", F.lit("new deals").alias("payload")))


@query("join_event_owner", """
    SELECT event_id, CASE WHEN c.c_custkey IS NULL THEN 'unknown user' WHEN c.c_custkey % 3 <> 0 AND c.c_custkey <> e.customer THEN 'mismatch' ELSE 'ok' END AS outcome
    FROM (SELECT event_id, user_id * 2 AS uid, user_id * 2 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS customer FROM events WHERE event_type = 'purchase') e
    LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 4) c ON c.c_custkey = e.uid""")
def join_event_owner(spark, d):
    """Payment events against the customer id stored for their user."""
    k = F.col("c_custkey")
    stored = tables.table(spark, d, "customer").where("c_custkey % 10 <> 4").select(
        k.alias("uid"), F.lit(True).alias("known"), F.when(k % 3 != 0, k).alias("stored"))
    ev = tables.table(spark, d, "events").where("event_type = 'purchase'").select(
        "event_id", (F.col("user_id") * 2).alias("uid"),
        (F.col("user_id") * 2 + F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)).alias("customer"))
    owner = F.when(F.col("known").isNull(), "unknown user").when(F.col("stored") != F.col("customer"), "mismatch").otherwise("ok")
    return ev.join(stored, "uid", "left").select("event_id", owner.alias("outcome"))


@query("bounded_link_reachability", """
    WITH RECURSIVE r AS (SELECT 'c0' AS n, 0 AS d UNION SELECT g.dst, r.d + 1 FROM r JOIN v_graph g ON g.src = r.n WHERE r.d < 3)
    SELECT n AS node, min(d) AS distance FROM r GROUP BY n""", ("v_graph",))
def bounded_link_reachability(spark, d):
    roots = tables.table(spark, d, "customer").where("c_custkey = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.reachable(cut_lineage(tables.graph(spark, d)), roots, 3)


@query("link_reachability_of_all", """
    WITH RECURSIVE e AS (SELECT a AS src, b AS dst FROM v_edges UNION SELECT b, a FROM v_edges),
    r AS (SELECT c_custkey AS root, c_custkey AS node, 0 AS d FROM customer UNION SELECT r.root, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.node WHERE r.d < 3)
    SELECT root, node, min(d) AS distance FROM r GROUP BY root, node""", ("v_edges",))
def link_reachability_of_all(spark, d):
    """Everybody's friends within three steps, from one walk for all users."""
    edges = social.both_ways(tables.edges(spark, d)).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    users = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("root"))
    return graph.reachable_from_each(cut_lineage(edges), users, 3)


@query("set_visited", """
    WITH RECURSIVE r AS (SELECT 'c0' AS n, 0 AS d UNION SELECT g.dst, r.d + 1 FROM r JOIN v_graph g ON g.src = r.n
      WHERE r.d < 2 AND (NOT starts_with(r.n, 'p') OR ends_with(r.n, '1'))) SELECT DISTINCT n AS node FROM r""", ("v_graph",))
def set_visited(spark, d):
    """Nodes visited when only some nodes are walked on from."""
    roots = tables.table(spark, d, "customer").where("c_custkey = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    walk = ~F.startswith(F.col("node"), F.lit("p")) | F.endswith(F.col("node"), F.lit("1"))
    return graph.reachable(cut_lineage(tables.graph(spark, d)), roots, 2, expand=walk).select("node")
