"""Repair of conversations by a run-length dynamic program over role and fault symbols.

A sound conversation has the role initials ``(s?(ua)+)?``. Rows of a conversation stand in order of turn (nulls first),
role, text. Each has the first fault that fits: ``blank`` (no character but blanks), ``duplicate`` (role and text stand
earlier in it), ``truncated`` (the last character that is no blank is none of ``.!?``). Edits are K(eep, 0), R(erole to
user or assistant, 1), D(elete, 2; the only one for blank and duplicate rows) and I(nsert an empty user or assistant row
anywhere, 5); a truncated row that stays costs 5 more. The cheapest edits are taken, among equals the string of
initials that is least in ASCII order.

Equal consecutive symbols (role class and fault) are one run. A row's symbol is a 4 x 4 min-plus matrix over the states
of the grammar; a run of n rows advances the costs by the cached binary powers of its matrix, and only then are the
choices unrolled, in steps of ``STEP`` rows between two costs that the powers give.

A conversation may hold most of the rows. The rows are sorted globally, so it lies in many range partitions; each
(conversation, partition) is a segment. Segments are reduced to their matrix and solved for each of the four states they
may begin in; two small chains (one row for each segment) give the costs behind a segment and the state before it.
Only ``digests`` reads a conversation in one task, row by row with bounded memory: SHA-256 is sequential by definition.

Defined cases: null roles and texts are one space; a role without a first letter in ``sua`` (also an empty one) cannot
be kept; a null conversation id is one conversation; repeated rows are rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import plain
from larder.session import cut_lineage

BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
WHOLE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant row that fits.
FITTING = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Role classes: s, u, a, other; legal neighbours.
LEGAL = {(0, 1), (1, 2), (2, 1)}
NEVER = 1 << 60
STEP = 256


def _kept(state: int, kind: int) -> int | None:
    """State after keeping a row of a role class."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind in (1, 2):
        return FITTING[state] if FITTING[state] == (USER, ASSISTANT)[kind - 1] else None
    return None


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


def _inserts() -> np.ndarray:
    m = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(m, 0)
    for state in range(4):
        m[state, FITTING[state]] = INSERT
    return _times(m, m)


def _row(symbol: int) -> np.ndarray:
    """Costs from state to state of one row and the inserts before it."""
    kind, fault = divmod(symbol, 4)
    m = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(m, DELETE)
    if fault in (WHOLE, TRUNCATED):
        extra = CUT if fault == TRUNCATED else 0
        for state in range(4):
            to = FITTING[state]
            m[state, to] = min(m[state, to], REROLE + extra)
            to = _kept(state, kind)
            if to is not None:
                m[state, to] = min(m[state, to], extra)
    return _times(_inserts(), m)


_powers: dict[int, list[np.ndarray]] = {}


def power(symbol: int, exponent: int) -> np.ndarray:
    """Matrix of 2 ** exponent equal rows."""
    own = _powers.setdefault(symbol, [_row(symbol)])
    while len(own) <= exponent:
        own.append(_times(own[-1], own[-1]))
    return own[exponent]


def advance(costs: np.ndarray, symbol: int, n: int) -> np.ndarray:
    """Costs before a run from the costs behind it: a vector, or a matrix with one column for each final state."""
    exponent = 0
    while n:
        if n & 1:
            m = power(symbol, exponent)
            costs = np.minimum((m + costs[None, :]).min(1) if costs.ndim == 1 else (m[:, :, None] + costs[None]).min(1), NEVER)
        n >>= 1
        exponent += 1
    return costs


#: Costs behind the last row: inserts that complete the pattern.
CLOSING = tuple(int(x) for x in np.minimum(_inserts()[:, START], _inserts()[:, ASSISTANT]))


@lru_cache(1 << 16)
def _choose(symbol: int, state: int, behind: tuple) -> tuple[str, int]:
    """Least initials of the cheapest edits at one row, and the state after it."""
    kind, fault = divmod(symbol, 4)
    here = advance(np.array(behind, np.int64), symbol, 1)
    extra, free, out = CUT if fault == TRUNCATED else 0, fault in (WHOLE, TRUNCATED), ""
    while True:
        to, kept = FITTING[state], _kept(state, kind)
        if DELETE + behind[state] == here[state]:
            return out + "D", state
        if INSERT + here[to] == here[state]:
            out, state = out + "I", to
        elif free and kept is not None and extra + behind[kept] == here[state]:
            return out + "K", kept
        else:
            return out + "R", to


def unroll(runs: tuple, behind: tuple, state: int, last: bool) -> tuple[str, int]:
    """Initials of the edits of some runs (symbol, length, ...) and the state after them."""
    pairs = list(zip(runs[::2], runs[1::2], strict=True))
    after, costs = [], np.array(behind, np.int64)
    for symbol, n in reversed(pairs):
        after.append(costs)
        costs = advance(costs, symbol, n)
    out = []
    for symbol, n in pairs:
        end = after.pop()
        while n:
            part = (n - 1) % STEP + 1
            own = [advance(end, symbol, n - part)]
            for _ in range(part - 1):
                own.append(advance(own[-1], symbol, 1))
            for costs in reversed(own):
                least = int(costs.min())
                piece, state = _choose(symbol, state, tuple(min(int(x) - least, NEVER) for x in costs))
                out.append(piece)
            n -= part
    while last and CLOSING[state]:
        out.append("I")
        state = FITTING[state]
    return "".join(out), state


@lru_cache(1 << 14)
def _remembered(runs: tuple, behind: tuple, state: int, last: bool) -> tuple[str, int]:
    return unroll(runs, behind, state, last)


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which nulls of the keys are equal."""
    other = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"__{k}"]) for k in keys))
    return left.join(other, on, how).drop(*(f"__{k}" for k in keys))


def _schema(rows: DataFrame, rest: str) -> T.StructType:
    """The type of a conversation id with further columns."""
    return T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T._parse_datatype_string(rest).fields])


def _emit(kind: pa.DataType, rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types], strict=True)], names=names)


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, block, at, turn, role, text): rows in global order, numbered, with the range partition they lie in."""
    rows = plain(turns, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    filled = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = filled.orderBy(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.rand(11))
    return cut_lineage(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", 33)))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv, block, at, symbol) of ordered rows."""
    first = rows.groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("first")).select("first")
    end = F.right(F.rtrim("text", F.lit(BLANK_CHARACTERS)), F.lit(1))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    small = rows.select("conv", "block", "at", kind.alias("kind"), end.alias("end"))
    fault = F.when(F.col("end") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(WHOLE)
    return small.join(first, small["at"] == first["first"], "left").select("conv", "block", "at", (F.col("kind") * 4 + fault).alias("symbol"))


def segments(coded: DataFrame) -> DataFrame:
    """One row for each (conversation, block): its runs, its matrix and its counts."""
    names = ["conv", "block", "first_at", "runs", "matrix", "blank", "duplicate", "truncated", "illegal", "first_kind", "last_kind"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 6]

    def close(conv, block, at, runs):
        costs = np.full((4, 4), NEVER, np.int64)
        np.fill_diagonal(costs, 0)
        many, illegal = [0] * 4, 0
        pairs = list(zip(runs[::2], runs[1::2], strict=True))
        for k in range(len(pairs) - 1, -1, -1):
            symbol, n = pairs[k]
            costs = advance(costs, symbol, n)
            many[symbol % 4] += n
            illegal += n - 1 + (k > 0 and (pairs[k - 1][0] // 4, symbol // 4) not in LEGAL)
        return conv, block, at, runs, costs.ravel().tolist(), *many[1:], illegal, runs[0] // 4, runs[-2] // 4

    def each(batches):
        key, at, runs, kind = None, 0, [], None
        for batch in batches:
            done, kind = [], batch.column(0).type
            for conv, block, spot, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, block):
                    if key is not None:
                        done.append(close(*key, at, runs))
                    key, at, runs = (conv, block), spot, [symbol, 0]
                elif runs[-2] != symbol:
                    runs += [symbol, 0]
                runs[-1] += 1
            yield _emit(kind, done, names, types)
        if key is not None:
            yield _emit(kind, [close(*key, at, runs)], names, types)

    near = coded.select("conv", "block", "at", "symbol").repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
    return cut_lineage(near.mapInArrow(each, _schema(coded, "block long, first_at long, runs array<long>, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first_kind long, last_kind long")))


def _listed(parts: DataFrame, *columns: str) -> DataFrame:
    """The segments of each conversation in order: at most as many as there are range partitions."""
    return parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("parts"))


def _behind(parts: DataFrame) -> DataFrame:
    """(conv, block, behind, is_first, is_last, cost, crossings): costs behind each segment, the conversation's cost at its first."""

    def each(batches):
        for batch in batches:
            out = []
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                costs, rows = np.array(CLOSING, np.int64), []
                for k in range(len(own) - 1, -1, -1):
                    behind = costs.tolist()
                    costs = np.minimum((np.array(own[k]["matrix"], np.int64).reshape(4, 4) + costs[None, :]).min(1), NEVER)
                    crossing = int(k > 0 and (own[k - 1]["last_kind"], own[k]["first_kind"]) not in LEGAL)
                    rows.append((conv, own[k]["block"], behind, k == 0, k == len(own) - 1, int(costs[START]) if k == 0 else 0, crossing))
                out += rows
            yield _emit(batch.column(0).type, out, ["conv", "block", "behind", "is_first", "is_last", "cost", "crossing"], [pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()])

    lists = _listed(parts, "matrix", "first_kind", "last_kind")
    return lists.mapInArrow(each, _schema(lists, "block long, behind array<long>, is_first boolean, is_last boolean, cost long, crossing long"))


def _solved(parts: DataFrame) -> DataFrame:
    """(conv, block, first_at, pieces, finals): edits of a segment for each state it may begin in, and the state after them."""

    def each(batches):
        for batch in batches:
            out = []
            for conv, block, at, runs, behind, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                run = _remembered if len(runs) <= 64 else unroll
                got = [run(tuple(runs), tuple(behind), state, last) for state in (range(1) if first else range(4))]
                out.append((conv, block, at, [p for p, _ in got], [s for _, s in got]))
            yield _emit(batch.column(0).type, out, ["conv", "block", "first_at", "pieces", "finals"], [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())])

    return cut_lineage(parts.select("conv", "block", "first_at", "runs", "behind", "is_first", "is_last").mapInArrow(each, _schema(parts, "block long, first_at long, pieces array<string>, finals array<long>")))


def _starts(solved: DataFrame) -> DataFrame:
    """(conv, block, start): the state each segment begins in."""

    def each(batches):
        for batch in batches:
            out = []
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state = START
                for part in own:
                    out.append((conv, part["block"], state))
                    state = part["finals"][state]
            yield _emit(batch.column(0).type, out, ["conv", "block", "start"], [pa.int64(), pa.int64()])

    lists = _listed(solved, "finals")
    return lists.mapInArrow(each, _schema(lists, "block long, start long"))


class Plan:
    """Edits of all conversations: ``rows`` (ordered), ``edits`` (conv, block, first_at, start, piece), ``found`` (one row a conversation)."""

    def __init__(self, turns: DataFrame, **columns):
        self.rows = ordered(turns, **columns)
        parts = segments(symbols(self.rows))
        behind = cut_lineage(_behind(parts))
        solved = _solved(_same(parts, behind, ["conv", "block"]))
        chosen = _same(solved, _starts(solved), ["conv", "block"])
        self.edits = cut_lineage(chosen.select("conv", "block", "first_at", "start", F.element_at("pieces", (F.col("start") + 1).cast("int")).alias("piece")))
        faults = _same(parts, behind.select("conv", "block", "cost", "crossing"), ["conv", "block"])
        counts = faults.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.col("crossing")).alias("illegal"), F.sum("cost").alias("cost"))
        turn = self.rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long").alias("gaps"))
        whole = self.edits.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p")).select("conv", F.expr("array_join(transform(p, x -> x.piece), '')").alias("audit"))
        self.found = _same(_same(counts, turn, ["conv"]), whole, ["conv"]).select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def stream(self, *keys: str) -> DataFrame:
        """Rows in order, each segment's edits before its first row; rows of equal ``keys`` in one task, read one by one."""
        rows = self.rows.select("conv", "block", "at", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(0).cast("long").alias("start"))
        heads = self.edits.select("conv", "block", F.col("first_at").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(self.rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("piece").alias("text"), "start")
        return rows.unionAll(heads).repartition(*keys).sortWithinPartitions("conv", "at", "kind")

    def repaired(self) -> DataFrame:
        """(conv, at, place, edit, turn, role, text) of all edits, deleted rows included; order is (at, place)."""
        names = ["conv", "at", "place", "edit", "turn", "role", "text"]
        turn = self.rows.schema["turn"].dataType.simpleString()

        def each(batches):
            reader = _Reader()
            for batch in batches:
                out = [(conv, *rest) for conv, _, *rest in _edited(batch, reader)]
                yield _emit(batch.column(0).type, out, names, [pa.int64(), pa.int64(), pa.string(), batch.column(4).type, pa.string(), pa.string()])

        return self.stream("conv", "block").mapInArrow(each, _schema(self.rows, f"at long, place long, edit string, turn {turn}, role string, text string"))

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256) of the repaired rows ``role:text``, joined by line ends."""

        def each(batches):
            reader, conv, sha, any_row, kind, started = _Reader(), None, None, False, pa.null(), False
            for batch in batches:
                out, kind = [], batch.column(0).type
                for own, fresh, _, _, edit, _, role, text in _edited(batch, reader):
                    if fresh:
                        if started:
                            out.append((conv, sha.hexdigest()))
                        conv, sha, any_row, started = own, hashlib.sha256(), False, True
                    if edit and edit != "D":
                        sha.update(("\n" if any_row else "").encode() + f"{role}:{text}".encode())
                        any_row = True
                yield _emit(kind, out, ["conv", "repaired_sha256"], [pa.string()])
            if started:
                yield _emit(kind, [(conv, sha.hexdigest())], ["conv", "repaired_sha256"], [pa.string()])

        return self.stream("conv").mapInArrow(each, _schema(self.rows, "repaired_sha256 string"))


class _Reader:
    """Where the edits of the segment at hand stand."""

    def __init__(self):
        self.key, self.piece, self.spot, self.state, self.at = None, "", 0, START, 0


def _edited(batch: pa.RecordBatch, r: _Reader):
    """(conv, is its first, at, place, edit, turn, role, text) of every edit; a segment's head gives an edit of None.

    Inserts before a row come with that row; those behind a segment's last row come with it.
    """
    for conv, block, at, head, turn, role, text, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if head == 0:
            fresh = r.key is None or r.key[0] != conv
            r.key, r.piece, r.spot, r.state = (conv, block), text, 0, start
            yield conv, fresh, at, 0, None, None, None, None
            continue
        place = 0
        while True:
            edit = r.piece[r.spot]
            r.spot += 1
            if edit != "I":
                break
            r.state = FITTING[r.state]
            yield conv, False, at, place, edit, None, ROLE_OF[r.state], ""
            place += 1
        if edit == "R":
            r.state = FITTING[r.state]
            role = ROLE_OF[r.state]
        elif edit == "K":
            r.state = _kept(r.state, {"s": 0, "u": 1, "a": 2}[role[0]])
        yield conv, False, at, place, edit, turn, role, text
        while len(r.piece) - r.spot <= 2 and r.piece[r.spot :] in ("I", "II"):  # behind the last row
            r.spot += 1
            place += 1
            r.state = FITTING[r.state]
            yield conv, False, at, place, "I", None, ROLE_OF[r.state], ""


def repair(turns: DataFrame, **columns) -> DataFrame:
    """Repaired conversations: (conv_id, at, place, edit, turn, role, text), ordered by (at, place) inside each."""
    done = Plan(turns, **columns).repaired()
    return done.where("edit is not null and edit <> 'D'").withColumnRenamed("conv", "conv_id")


def report(turns: DataFrame, **columns) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation with rows."""
    plan = Plan(turns, **columns)
    return _same(plan.found, plan.digests(), ["conv"])
