"""Streaming jobs run over the stored event files, checked against their table form."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import fixed_values as fv
from larder.functions.dates import epoch_micros
from larder.operators import windows
from larder.operators.scaling import keep_first
from larder.plans.registry import query
from larder.sources import tables
from larder.streaming import jobs


#: How late an event may be among the stored files and still count at its place.
WAIT = "365 days"


@query("event_log_source", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def event_log_source(spark, d):
    log = jobs.run_to_table(jobs.read_events(spark, d).select("event_id", "event_type"), "event-log")
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("message_append_sink", "SELECT conv_id, turn, role AS sender, length(text) AS n FROM conversations")
def message_append_sink(spark, d):
    """Messages appended with the server's time."""
    schema = tables.table(spark, d, "conversations").schema
    stream = jobs.read_stream(spark, d, "conversations.parquet", schema)
    stored = jobs.run_to_table(stream.withColumn("created_at", F.current_timestamp()), "messages")
    return stored.where("created_at IS NOT NULL").select("conv_id", "turn", F.col("role").alias("sender"), F.length("text").alias("n"))


def as_messages(events):
    room = F.col("user_id") % 40
    return events.select(
        F.col("event_id").alias("id"), room.alias("share_key"),
        F.when(F.col("event_type") == "purchase", (room + 1) % 40).alias("target_key"),
        F.array((room + 1) % 40, (room + 7) % 40, room).alias("friend_keys"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("sender_name"),
        F.when(F.col("event_id") % 3 == 0, "stop").otherwise("start").alias("signal"))


@query("stream_message_fanout", """
    WITH m AS (SELECT event_id AS id, user_id % 40 AS r, event_type = 'purchase' AS dm FROM events)
    SELECT id, r AS room FROM m UNION ALL SELECT id, (r + 1) % 40 FROM m UNION ALL SELECT id, (r + 7) % 40 FROM m WHERE NOT dm""")
def stream_message_fanout(spark, d):
    return jobs.run_to_table(jobs.message_rooms(as_messages(jobs.read_events(spark, d))), "fanout")


@query("stream_typing_fanout", """
    WITH m AS (SELECT event_id AS id, user_id % 40 AS r, CASE WHEN event_id % 3 = 0 THEN 'stop' ELSE 'start' END AS signal FROM events WHERE event_id % 3 = 0 OR event_type <> 'error')
    SELECT id, (r + 1) % 40 AS room, signal FROM m UNION ALL SELECT id, (r + 7) % 40, signal FROM m""")
def stream_typing_fanout(spark, d):
    return jobs.run_to_table(jobs.typing_rooms(as_messages(jobs.read_events(spark, d))), "typing")


@query("stream_room_membership", """
    WITH l AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'error') AS gone FROM events GROUP BY 1)
    SELECT DISTINCT e.user_id AS socket, CASE event_type WHEN 'view' THEN 'r' || event_id % 10 WHEN 'signup' THEN 'user_' || e.user_id ELSE 'friend' || event_id % 5 END AS room
    FROM events e JOIN l ON e.user_id = l.user_id WHERE event_type IN ('view', 'signup', 'purchase') AND (gone IS NULL OR ts > gone)""")
def stream_room_membership(spark, d):
    """Rooms each socket is in at the end of the log."""
    t, i = F.col("event_type"), F.col("event_id")
    room = F.when(t == "view", F.concat(F.lit("r"), (i % 10).cast("string"))).when(
        t == "signup", F.concat(F.lit("user_"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("friend"), (i % 5).cast("string")))
    actions = jobs.read_events(spark, d).where(t != "click").select(
        F.col("user_id").alias("socket"), "event_id", epoch_micros("ts").alias("t"),
        F.when(t == "error", "disconnect").otherwise("join").alias("action"), room.alias("room"))
    with jobs.state_store(spark):
        changes = jobs.run_log_in_order(actions, "rooms", lambda log: jobs.room_changes(log, WAIT))
    return changes.groupBy("socket", "room").agg(F.sum("change").alias("n")).where("n > 0").select("socket", "room")


@query("stream_ttl_expiry", """
    SELECT user_id % 40 AS room, event_id FROM events WHERE epoch_ms(ts) + 86400000 < (SELECT max(epoch_ms(ts)) FROM events)""")
def stream_ttl_expiry(spark, d):
    """Messages given up by the state 24 h of event time after they were sent."""
    us = epoch_micros("ts")
    m = jobs.read_events(spark, d).select(
        (F.col("user_id") % 40).alias("room"), "event_id", F.timestamp_micros(us).alias("at"), F.floor(us / 1000).alias("ms"))
    with jobs.state_store(spark):
        return jobs.run_to_table(jobs.expired_messages(m.withWatermark("at", "0 seconds")), "expired")


RATE_SQL = """WITH RECURSIVE c AS (SELECT * FROM (VALUES {0}) v(name, lim, width)),
    e AS (SELECT c.*, event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY name, user_id ORDER BY ts, event_id) AS rn FROM events, c),
    r AS (SELECT name, lim, width, event_id, user_id, rn, t + width AS reset_at, 1 AS cnt, true AS admitted FROM e WHERE rn = 1
      UNION ALL SELECT e.name, e.lim, e.width, e.event_id, e.user_id, e.rn, CASE WHEN e.t > r.reset_at THEN e.t + e.width ELSE r.reset_at END,
        CASE WHEN e.t > r.reset_at THEN 1 WHEN r.cnt < r.lim THEN r.cnt + 1 ELSE r.cnt END, e.t > r.reset_at OR r.cnt < r.lim
      FROM r JOIN e ON e.user_id = r.user_id AND e.name = r.name AND e.rn = r.rn + 1)"""
DAY_US = 86_400_000_000


@query("stream_rate_limit", RATE_SQL.format(f"('day', 2, {DAY_US})") + " SELECT event_id, admitted FROM r")
def stream_rate_limit(spark, d):
    """Two hits per user in a 24 h window that opens at the first hit."""
    hits = jobs.read_events(spark, d).select("event_id", "user_id", epoch_micros("ts").alias("t"))
    with jobs.state_store(spark):
        return jobs.run_log_in_order(hits, "admitted", lambda log: jobs.rate_limited(log, 2, 86_400, delay=WAIT))


LIMITS = [("day", 2, 86_400)] + [(name, hits, seconds) for name, (hits, seconds) in fv.RATE_LIMITS.items()]


@query("stream_quota_windows", RATE_SQL.format(", ".join(f"('{n}', {k}, {s * 1_000_000})" for n, k, s in LIMITS)) + " SELECT name, event_id, admitted FROM r")
def stream_quota_windows(spark, d):
    """All admission windows at once, over the stored log."""
    limits = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("limit"), F.lit(s * 1_000_000).cast("bigint").alias("window")) for n, k, s in LIMITS])
    hits = tables.table(spark, d, "events").select("event_id", "user_id", epoch_micros("ts").alias("t"), F.inline(limits))
    return windows.admit(hits, ["name", "user_id"]).select("name", "event_id", "admitted")


@query("stream_subscription_state", """
    SELECT user_id, event_type = 'purchase' AS is_premium, CASE WHEN event_type = 'purchase' THEN 'plan' || event_id % 2 END AS premium_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('purchase', 'signup')) t
    WHERE rn = 1 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def stream_subscription_state(spark, d):
    t = F.col("event_type")
    paid = jobs.read_events(spark, d).where(t.isin("purchase", "signup", "error")).select(
        "user_id", "event_id", epoch_micros("ts").alias("t"),
        F.when(t == "purchase", "completed").when(t == "signup", "deleted").otherwise("failed").alias("kind"),
        F.concat(F.lit("plan"), (F.col("event_id") % 2).cast("string")).alias("plan"),
        F.concat(F.lit("sub"), F.col("user_id").cast("string")).alias("subscription"))
    with jobs.state_store(spark):
        states = jobs.run_log_in_order(paid, "plans", lambda log: jobs.subscription_states(log, WAIT))
    return keep_first(states, ["user_id"], [F.desc("t")]).drop("t")


@query("stream_first_seen", "SELECT DISTINCT event_id % 700 AS k FROM events")
def stream_first_seen(spark, d):
    keyed = jobs.read_events(spark, d).select((F.col("event_id") % 700).alias("k"), "ts")
    with jobs.state_store(spark):
        return jobs.run_to_table(jobs.first_seen(keyed, "k", "ts", "90 days"), "seen")


@query("stream_upsert", """
    WITH o AS (SELECT product_id, price, is_on_sale, pos, order_key % 2 AS half FROM v_offers),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY half DESC, pos DESC) AS rn FROM o)
    SELECT product_id, price, is_on_sale FROM ranked WHERE rn = 1""", ("v_offers",))
def stream_upsert(spark, d):
    cols = ["product_id", "price", "is_on_sale"]
    base = keep_first(tables.offers(spark, d).where("order_key % 2 = 0"), ["product_id"], [F.desc("pos")]).select(cols)
    raw = jobs.read_stream(spark, d, "lineitem.parquet", tables.table(spark, d, "lineitem").schema)
    changes = tables.offers_of(raw).where("order_key % 2 = 1").select(*cols, "pos")
    return jobs.upsert_stream(changes, ["product_id"], ["pos"], base)


@query("stream_available_now", "SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1")
def stream_available_now(spark, d):
    """A periodic refresh: the stream job catches up with all files and stops."""
    fresh = jobs.run_to_table(jobs.read_events(spark, d, per_batch=64 << 20).select("event_id", "ts"), "refresh")
    return fresh.groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))
