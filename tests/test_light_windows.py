"""Admission windows: keys with few hits are walked, others doubled; both give the rows of a plain loop."""

import random

import pytest

from larder.operators import windows


def admitted(rows, limit, width):
    out, state = {}, {}
    for event_id, user, t in sorted(rows, key=lambda r: (r[2], r[0])):
        count, reset = state.get(user, (0, None))
        if reset is None or t > reset:
            count, reset = 0, t + width
        out[event_id] = count < limit
        state[user] = count + out[event_id], reset
    return out


@pytest.mark.parametrize("light", [windows.LIGHT, 60, 0])
def test_walked_and_doubled(spark, light):
    rng = random.Random(11)
    rows = [(i, rng.choice([1, 1, 1, rng.randrange(2, 30)]), rng.randrange(4000)) for i in range(600)]
    hits = spark.createDataFrame([(*r, 100, 3) for r in rows], "event_id long, user_id long, t long, window long, limit int")
    got = windows.admit(hits, ["user_id"], light).collect()
    assert len(got) == 600 and {r.event_id: r.admitted for r in got} == admitted(rows, 3, 100)


def test_light_keys_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(windows, "anchors", None)  # calling it would fail
    hits = spark.createDataFrame([(i, i % 5, i, 50, 2) for i in range(200)], "event_id long, user_id long, t long, window long, limit int")
    got = windows.admit(hits, ["user_id"]).collect()
    assert {r.event_id: r.admitted for r in got} == admitted([(i, i % 5, i) for i in range(200)], 2, 50)
