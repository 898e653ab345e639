"""Chat history cut before the join, against plain Python over all messages."""

import random

from larder.operators import social

MESSAGES = "id long, share_key string, target_key string, created_at int"


def messages(spark, n=3000):
    rng = random.Random(3)
    rows = []
    for i in range(n):  # a third of all messages in one room
        room = "HOT" if i % 3 == 0 else rng.choice("ABCD")
        rows.append((i, room, None if rng.random() < 0.6 else rng.choice(["A", "B", "C", "D", "HOT", room]), rng.randrange(n // 4)))
    return rows, spark.createDataFrame(rows, MESSAGES).repartition(7)


def allowed(own, friends):
    return [k for k in ([own.strip().upper()] + [f.strip().upper() for f in friends or []]) if k]


def oldest(rows, test, most):
    return [i for _, i in sorted((at, i) for i, x, t, at in rows if test(x, t))[:most]]


def rows_by_request(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.request_id, r.rn or 0)):
        got.setdefault(r.request_id, []).append(None if r.refused else r.id)
    return got


def test_group_history(spark):
    rows, frame = messages(spark)
    asked = [(1, " a", ["b"], None), (2, "A", ["B", "hot "], ["hot", "b", " A"]), (3, "A", ["B"], ["B", "C"]), (4, "HOT", [], []), (5, "A", None, ["", " "]), (6, "D", ["HOT"], ["HOT", "HOT"])]
    asked += [(7, "A", [f"F{i}" for i in range(40)] + ["HOT"], [f"f{i}" for i in range(25)] + ["HOT", "stranger"])]
    want = {}
    for rid, own, friends, keys in asked:
        ok = allowed(own, friends)
        wanted = [k.strip().upper() for k in keys or [] if k.strip()][:25]
        if set(wanted) - set(ok):
            want[rid] = [None]
            continue
        me = own.strip().upper()
        rooms = wanted or [me]
        want[rid] = oldest(rows, lambda x, t: (x in rooms and t is None) or (x == me and t in rooms) or (t == me and x in rooms), 200)  # noqa: B023
    requests = spark.createDataFrame(asked, "request_id int, own string, friends array<string>, keys array<string>")
    assert rows_by_request(social.group_history(frame, requests)) == {k: v for k, v in want.items() if v}
    assert len(want[2]) == 200 and want[3] == [None]


def test_room_history(spark):
    rows, frame = messages(spark)
    asked = [(1, "A", ["B", "HOT"], "a "), (2, "A", ["B", "HOT"], "HOT"), (3, "A", ["B"], "C"), (4, "HOT", ["A", "B", "C", "D"], "HOT"), (5, "B", [], "B"), (6, "A", ["B"], None)]
    want = {}
    for rid, own, friends, room in asked:
        ok, room = allowed(own, friends), (room or "").strip().upper()
        if room not in ok:
            want[rid] = [None]
        elif room == own:
            want[rid] = oldest(rows, lambda x, t: (x == own and t is None) or (x == own and t in ok) or (t == own and x in ok), 100)  # noqa: B023
        else:
            want[rid] = oldest(rows, lambda x, t: (x == room and t is None) or (x == own and t == room) or (x == room and t == own), 100)  # noqa: B023
    requests = spark.createDataFrame(asked, "request_id int, own string, friends array<string>, room string")
    assert rows_by_request(social.room_history(frame, requests)) == want


def test_rooms_are_cut_below_the_join(spark):
    """The plan limits each key before its shuffle, and no key sends more rows than the limit to the join."""
    rows, frame = messages(spark)
    requests = spark.createDataFrame([(1, "A", "HOT"), (2, "HOT", "A")], "request_id int, own string, room string")
    keys = social.wanted_keys(requests)
    found = social.oldest_of_keys(frame, keys, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = max(plan.find("BroadcastHashJoin"), plan.find("SortMergeJoin"), plan.find("ShuffledHashJoin"))
    assert plan.find("WindowGroupLimit", join) > join  # below the join
    assert found.where("request_id = 1").count() == 10
    few = social.top_k(social._filed(frame), ["k"], ["created_at", "id"], 10)
    assert max(r["count"] for r in few.groupBy("k").count().collect()) == 10
