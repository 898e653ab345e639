"""Friend edges, message visibility, quotas, subscriptions and payment state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.dates import days_left
from larder.operators.scaling import keep_first, top_k


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each edge in both directions, in one pass over the input."""
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col(a).alias("a"), F.col(b).alias("b")),
                F.struct(F.col(b).alias("a"), F.col(a).alias("b")),
            )
        ).alias("e")
    ).select("e.a", "e.b")


def add_edges(existing: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """Directed edges to append for friend requests (a asks b).

    Self requests and unknown users are refused; an edge already stored is not
    added again; both directions are checked separately.
    """
    known = users.select(F.col("id"))
    valid = (
        requests.where("a <> b")
        .join(known.withColumnRenamed("id", "a"), "a", "left_semi")
        .join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    )
    return both_ways(valid).distinct().join(existing.select("a", "b"), ["a", "b"], "left_anti")


def remove_edges(existing: DataFrame, removals: DataFrame) -> DataFrame:
    return existing.join(both_ways(removals), ["a", "b"], "left_anti")


def access_state(users: DataFrame, now: Column) -> DataFrame:
    trial = F.coalesce(F.col("trial_ends_at") > now, F.lit(False))
    paid = F.coalesce(F.col("is_premium"), F.lit(False))
    return users.select(
        "id",
        (paid | trial).alias("is_premium"),
        paid.alias("is_real_premium"),
        (trial & ~paid).alias("is_on_trial"),
        "trial_ends_at",
        F.when(trial & ~paid, days_left(F.col("trial_ends_at"), now)).otherwise(0).alias("trial_days_left"),
    )


def allowed_keys(own, friends) -> Column:
    """Own key and friend keys, trimmed, upper case, no blanks, no repeats."""
    clean = lambda k: F.upper(F.trim(k.cast("string")))
    listed = F.coalesce(F.transform(friends, clean), F.array().cast("array<string>"))
    every = F.concat(F.array(F.coalesce(clean(own), F.lit(""))), listed)
    return F.array_distinct(F.filter(every, lambda k: F.coalesce(k, F.lit("")) != ""))


def wanted_keys(requests: DataFrame) -> DataFrame:
    """(request_id, k) of requests (request_id, own, room)."""
    return requests.select("request_id", F.explode(room_keys(F.col("own"), F.array("room"))).alias("k")).distinct()


def visible_messages(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages each request may read.

    ``requests`` has (request_id, own, room), one row per requested room. Group
    messages of the room, and direct messages between own and room either way.
    The OR of three conditions is written as one equi-join on a lookup key that
    both sides build, so it never becomes a nested loop.
    """
    # a message has one key and a request holds each key once, so no pair repeats
    return _filed(messages).join(wanted_keys(requests), "k").drop("k")


def _filed(messages: DataFrame) -> DataFrame:
    """Messages with the one lookup key they are found under."""
    key = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    group = key("group", F.col("share_key"), F.col("share_key"))
    return messages.withColumn("k", F.when(F.col("target_key").isNull(), group).otherwise(key("direct", F.col("share_key"), F.col("target_key"))))


def oldest_of_keys(messages: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(request_id, id, rn): the oldest ``most`` messages of each request's lookup keys; ``wanted`` has (request_id, k).

    A request's oldest messages lie among the oldest of its keys, so each key is cut to ``most`` messages before the
    join. A room of any length sends at most that many rows on.
    """
    filed = _filed(messages).select("k", "created_at", "id")
    few = top_k(filed, ["k"], ["created_at", "id"], most)
    found = few.join(wanted.select("request_id", "k").distinct(), "k")
    return top_k(found, ["request_id"], ["created_at", "id"], most, rank="rn").select("request_id", "id", "rn")


def clean_keys(keys) -> Column:
    """Keys trimmed, upper case, blanks dropped."""
    return F.filter(F.transform(keys, lambda k: F.upper(F.trim(k.cast("string")))), lambda k: F.coalesce(k, F.lit("")) != "")


def room_keys(own: Column, rooms: Column) -> Column:
    """Lookup keys of group messages of rooms and of direct messages between ``own`` and them, either way."""
    key = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    each = F.transform(rooms, lambda r: F.array(key("group", r, r), key("direct", own, r), key("direct", r, own)))
    return F.array_distinct(F.flatten(each))


def group_history(messages: DataFrame, requests: DataFrame, most: int = 200, most_keys: int = 25) -> DataFrame:
    """(request_id, refused, id, rn): history of a request's rooms together, oldest ``most`` first.

    ``requests`` has (request_id, own, friends, keys). The first ``most_keys`` of the asked keys count, the own key if
    none is asked. A request with a key that is neither its own nor a friend's is refused and returned without message.
    """
    own = F.upper(F.trim(F.col("own").cast("string")))
    asked = requests.select("request_id", own.alias("own"), F.slice(clean_keys("keys"), 1, most_keys).alias("keys"), allowed_keys(F.col("own"), F.col("friends")).alias("allowed"))
    refused = F.coalesce(F.size(F.array_except("keys", "allowed")) > 0, F.lit(False))
    rooms = F.when(F.coalesce(F.size("keys"), F.lit(0)) > 0, F.col("keys")).otherwise(clean_keys(F.array("own")))
    open_ = asked.where(~refused).select("request_id", F.explode(room_keys(F.col("own"), rooms)).alias("k"))
    found = oldest_of_keys(messages, open_, most).select("request_id", F.lit(False).alias("refused"), "id", "rn")
    none = asked.where(refused).select("request_id", F.lit(True).alias("refused"), F.lit(None).cast(messages.schema["id"].dataType).alias("id"), F.lit(None).cast("int").alias("rn"))
    return found.unionByName(none)


def room_history(messages: DataFrame, requests: DataFrame, most: int = 100) -> DataFrame:
    """(request_id, refused, id, rn): history of one room, oldest ``most`` first.

    ``requests`` has (request_id, own, friends, room). In the own room the group messages stand beside all direct messages
    with oneself and with friends; in a friend's room only those between the two. Any other room is refused.
    """
    clean = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    asked = requests.select("request_id", clean("own").alias("own"), clean("room").alias("room"), allowed_keys(F.col("own"), F.col("friends")).alias("allowed"))
    good = F.coalesce(F.array_contains("allowed", F.col("room")), F.lit(False))
    mine = F.col("own") == F.col("room")
    key = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    own_room = F.concat(
        F.array(key("group", F.col("own"), F.col("own"))),
        F.flatten(F.transform("allowed", lambda r: F.array(key("direct", F.col("own"), r), key("direct", r, F.col("own"))))))
    keys = F.when(mine, F.array_distinct(own_room)).otherwise(room_keys(F.col("own"), F.array("room")))
    open_ = asked.where(good).select("request_id", F.explode(keys).alias("k"))
    found = oldest_of_keys(messages, open_, most).select("request_id", F.lit(False).alias("refused"), "id", "rn")
    none = asked.where(~good).select("request_id", F.lit(True).alias("refused"), F.lit(None).cast(messages.schema["id"].dataType).alias("id"), F.lit(None).cast("int").alias("rn"))
    return found.unionByName(none)


def list_quota(access: DataFrame, premium: int = 10, free: int = 2) -> DataFrame:
    return access.withColumn("list_limit", F.when(F.col("is_premium"), premium).otherwise(free))


def payment_state(events: DataFrame) -> DataFrame:
    """Last completed or deleted event of each user decides the subscription."""
    relevant = events.where(F.col("kind").isin("completed", "deleted"))
    last = keep_first(relevant, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return last.select(
        "user_id",
        (F.col("kind") == "completed").alias("is_premium"),
        F.when(F.col("kind") == "completed", F.col("plan")).alias("premium_type"),
    )
