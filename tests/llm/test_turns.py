"""Conversation repair against exhaustive recursion on small, odd and long conversations."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from larder.llm import queries, turns

BLANKS = " \t\n\x0b\x0c\r"


def fits(done):
    body = done[1:] if done.startswith("s") else done
    return done == "" or (len(body) > 0 and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def exhaustive(rows):
    """Backward: least (cost, audit) from each row and state, with up to two inserts before each row."""
    state_next = {"": {"u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    later = {"": (0, "", ()), "a": (0, "", ()), "u": (5, "I", (("assistant", None),)), "s": (10, "II", (("user", None), ("assistant", None)))}
    for k in range(len(rows) - 1, -1, -1):
        role, fault = rows[k]
        now = {}
        for tail in ("", "s", "u", "a"):
            options, at, cost, audit, added = [], tail, 0, "", ()
            for _ in range(3):
                c, a, r = later[at]
                options.append((cost + c + 2, audit + "D" + a, added + r))
                if fault in ("", "truncated"):
                    extra = 5 if fault else 0
                    if role[:1] == "s" and at == "":
                        c, a, r = later["s"]
                        options.append((cost + c + extra, audit + "K" + a, (*added, (role, k), *r)))
                    if role[:1] in state_next[at]:
                        c, a, r = later[state_next[at][role[0]]]
                        options.append((cost + c + extra, audit + "K" + a, (*added, (role, k), *r)))
                    (letter,) = state_next[at]
                    c, a, r = later[letter]
                    options.append((cost + c + extra + 1, audit + "R" + a, (*added, (names[letter], k), *r)))
                (letter,) = state_next[at]
                cost, audit, added, at = cost + 5, audit + "I", (*added, (names[letter], None)), letter
            now[tail] = min(options, key=lambda o: o[:2])
        later = now
    return later[""]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        inner = text.rstrip(BLANKS)
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def expected(rows):
    """Contract row of one conversation's rows (turn, role, text) in order."""
    said = [(role, text) for _, role, text in rows]
    found = faults(said)
    cost, audit, left = exhaustive(list(zip([r for r, _ in said], found, strict=True)))
    known_turns = [t for t, _, _ in rows if t is not None]
    pairs = list(zip([r[:1] for r, _ in said], [r[:1] for r, _ in said][1:]))
    text = "\n".join(f"{role}:{'' if k is None else said[k][1]}" for role, k in left)
    assert fits("".join(role[:1] for role, _ in left))
    return (
        max(known_turns) - min(known_turns) + 1 - len(set(known_turns)) if known_turns else 0,
        found.count("blank"), found.count("duplicate"), found.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def hurt(rows):
    """The contract's damage of rows (conv_id, turn, role, text), by conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(r, key=order) for c, r in out.items()}


def small_rows():
    rng = random.Random(8)
    rows = []
    for conv in [*range(400), None]:
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", "User", None])
            text = rng.choice(["Yes.", "No", "Why?", "Well. ", "a" * rng.randint(0, 3), " \t", "Ü!\n\n", "x. ", None, f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None, -turn]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, conv string, block string, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)


def table_of(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_query_equals_exhaustive_edits(spark, tmp_path):
    rows = small_rows()
    got = {r[0]: tuple(r[1:9]) for r in queries.QUERIES["op11_run_length_repair"](spark, table_of(spark, rows, tmp_path)).collect()}
    want = {c: expected(r) for c, r in hurt(rows).items()}
    assert got == want


def test_given_conversations_equal_exhaustive_edits(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:9]) for r in queries.QUERIES["op11_run_length_repair"](spark, sf_dir).collect()}
    assert got == {c: expected(r) for c, r in hurt(rows).items()}


def test_one_long_conversation_spans_partitions(spark):
    """Long runs, many segments, more rows than one step; the same answer as the recursion."""
    rng = random.Random(2)
    rows, turn = [], 0
    while len(rows) < 6000:
        role = rng.choice(["user", "assistant", "system", "tool"])
        for _ in range(rng.choice([1, 1, 1, 2, 700])):
            rows.append((7, turn, role, f"{role} {turn}" + rng.choice([".", ".", ".", ""]) if rng.random() < 0.97 else "same."))
            turn += 1
    rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]
    given = frame(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = turns.Plan(given)
        assert plan.edits.where("conv = 7").count() > 2  # several segments
        found = plan.found.collect(), plan.digests().collect(), plan.repaired().where("conv = 7 and edit <> 'D'").orderBy("at", "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {c: expected([(t, r, x) for k, t, r, x in rows if k == c]) for c in (7, 8)}
    shas = {r.conv: r.repaired_sha256 for r in found[1]}
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, shas[r.conv]) for r in found[0]}
    assert got == want
    text = "\n".join(f"{r.role}:{r.text}" for r in found[2])
    assert hashlib.sha256(text.encode()).hexdigest() == want[7][7]


def test_powers_equal_single_rows():
    rng = np.random.default_rng(1)
    for symbol in range(16):
        for n in (1, 2, 5, 31, 700):
            costs = rng.integers(0, 30, 4)
            slow = costs
            for _ in range(n):
                slow = turns.advance(slow, symbol, 1)
            assert (turns.advance(costs, symbol, n) == slow).all()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, 3, "system", "Only me.")]])
def test_empty_and_null_rows(spark, tmp_path, rows):
    got = {r[0]: tuple(r[1:9]) for r in queries.QUERIES["op11_run_length_repair"](spark, table_of(spark, rows, tmp_path)).collect()}
    assert got == {c: expected(r) for c, r in hurt(rows).items()}
