"""Conversation structure repair by a rank-compressed dynamic program.

Rows of a conversation are kept, given another role or deleted, and empty turns are inserted, at the
least cost that makes the roles an optional system turn followed by user and assistant in turn. A
macro edit is a run of inserts and the turn behind it; its code (D, IK, R, ...) is never the start of
another code, so audit strings of equally many macros compare as their codes do, one by one. A layer
of the program holds, for each state of the role pattern, the least cost and the rank of its audit
string among the states'; the string itself is never built. A back pointer names the state before and
the macro, and the edits are read off backward.

Rows are put in order by ranges of (conversation, turn, role, text), so that a conversation of any
size is dealt over many tasks. The stretch of a conversation in one task is solved for every state it
may begin in; the stretches' costs and ranks are then joined state by state, one small record a
stretch, and each stretch is walked back from the state it has to end in. Only rows that are equal in
everything are joined into one record with a count, before any shuffle.

Defined results: null roles and texts are one space; a null conversation id is a conversation, null
turns come first; rows of one turn are in order of role, then text; rows that are equal in everything
stand side by side; roles other than user, assistant and system are known by their first letter; an
empty table gives no rows; texts of any length are carried whole; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.bpe import small_batches
from ledgerspark.llm.shared import materialize

#: White space; the marks that end a text that is not cut off.
SPACE, ENDS = "\\x20\\x09-\\x0D", "[.!?]"
#: Costs of a new role, of deleting, of inserting, and of a cut-off text that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States of the role pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state: the initial and the state after it. Inserted and new roles are no system turns.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Codes of macro edits in order, and the inserts that end a conversation from each state.
CODES = ["D", "ID", "IK", "IR", "K", "R"]
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ROLE = {"u": "user", "a": "assistant"}
NEVER = 1 << 60


def _turned(state: int) -> tuple[str, int]:
    """The role that an inserted or a new turn has after a state, and the state it leads to."""
    return next((x, to) for x, to in FOLLOWS[state].items() if x != "s")


def macros(initial: str, cut_off: bool) -> Iterator[tuple[int, int, int, int]]:
    """(state, state after, cost, code) of all macro edits of a turn that need not be deleted.

    A run of two inserts ends in a state that allows no more than the one it began in, so no cheapest
    edit has one before a turn.
    """
    for state in FOLLOWS:
        for run in (0, 1):
            at = _turned(state)[1] if run else state
            base, stay = INSERT * run, CUT_OFF * cut_off
            yield state, at, base + DELETE, CODES.index("I" * run + "D")
            if initial in FOLLOWS[at]:
                yield state, FOLLOWS[at][initial], base + stay, CODES.index("I" * run + "K")
            yield state, _turned(at)[1], base + stay + REROLE, CODES.index("I" * run + "R")


@lru_cache(1 << 16)
def step(layer: tuple, initial: str, cut_off: bool) -> tuple[int, tuple, tuple]:
    """The next layer. layer: (cost, rank) by state, the least cost 0; layers come again and again,
    so they are remembered. Returns the least cost, the layer above it, and (state, code) by state."""
    best: dict[int, tuple] = {}
    for state, to, cost, code in macros(initial, cut_off):
        if layer[state]:
            offer = (layer[state][0] + cost, layer[state][1], code, state)
            best[to] = min(best.get(to, offer), offer)
    least = min(x[0] for x in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    after = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
    return least, after, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


def begun(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def solve_stretch(rows: list[tuple[str, bool, bool]]) -> list[list[tuple[int, int]]]:
    """For rows of (initial, cut off, must go): [state before][state after] -> (cost, rank)."""
    out = []
    for state in range(4):
        layer, cost = begun(state), 0
        for initial, cut_off, gone in rows:
            if not gone:
                least, layer, _ = step(layer, initial, cut_off)
                cost += least
        out.append([(cost + x[0], x[1]) if x else (NEVER, 0) for x in layer])
    return out


def walk_back(rows: list[tuple[str, bool, bool]], state: int, end: int) -> list[tuple[str, int]]:
    """The code of each row's macro edit and the state before it, for given states at both ends."""
    layer, pointers, out = begun(state), [], []
    for initial, cut_off, gone in rows:
        if not gone:
            _, layer, back = step(layer, initial, cut_off)
            pointers.append(back)
    for _, _, gone in reversed(rows):
        if not gone:
            end, code = pointers.pop()[end]
        out.append(("D" if gone else CODES[code], end))
    return out[::-1]


def join_stretches(tables: list[list]) -> tuple[int, list[int]]:
    """The least cost of a conversation and the states at its stretches' ends, the first one START.

    tables: of the stretches in order, [4 * state before + state after] -> cost, and so for ranks.
    """
    layer, pointers = [(0, 0), None, None, None], []
    for costs, ranks in tables:
        best: dict[int, tuple] = {}
        for a, known in enumerate(layer):
            for b in range(4):
                if known and (cost := costs[4 * a + b]) < NEVER:
                    offer = (known[0] + cost, known[1], ranks[4 * a + b], a)
                    best[b] = min(best.get(b, offer), offer)
        order = sorted(best, key=lambda s: best[s][1:3])
        layer = [(best[s][0], order.index(s)) if s in best else None for s in range(4)]
        pointers.append([best[s][3] if s in best else None for s in range(4)])
    cost, _, at = min((x[0] + INSERT * TAIL[s], x[1], s) for s, x in enumerate(layer) if x)
    states = [at]
    for back in reversed(pointers):
        states.append(at := back[at])
    return cost, states[::-1]


def damage(rows: DataFrame) -> DataFrame:
    """Damaged rows (conv_id, turn, role, text, copies), by a hash of conversation and turn: dropped,
    emptied, without end marks, repeated, or made a user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(one("text"), ENDS, "")).otherwise(one("text"))
    role = F.when(fate == 4, "user").otherwise(one("role"))
    return rows.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) in order, stored with place, stretch and their faults.

    place: the task and the row's place in it; a stretch is a conversation's part in one task.
    """
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*keys).agg(F.sum("copies").alias("copies")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    blank = ~F.rlike("text", F.lit(f"[^{SPACE}]"))
    cut_off = ~blank & ~F.rlike("text", F.lit(f"{ENDS}[{SPACE}]*\\z"))
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(f"h{seed}") for seed in (0, 1)]
    rows = materialize(rows.select("*", F.monotonically_increasing_id().alias("place"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut_off.alias("cut_off"), *hashes))
    return rows.withColumn("part", F.shiftright("place", 33))


def facts_of(rows: DataFrame) -> DataFrame:
    """Without texts, stored: rows and whether an earlier row of the conversation has the same role and text."""
    small = rows.select("conv_id", "part", "place", "turn", "initial", "blank", "cut_off", "copies", "h0", "h1")
    again = small.groupBy(F.col("conv_id").alias("_conv"), F.col("h0").alias("_h0"), F.col("h1").alias("_h1")).agg(F.min("place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = small.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("h0") == F.col("_h0")) & (F.col("h1") == F.col("_h1")), "left")
    return materialize(joined.select("conv_id", "part", "place", "turn", "initial", "blank", "cut_off", "copies", (F.coalesce("_first", "place") < F.col("place")).alias("seen")))


def stretches(facts: DataFrame) -> DataFrame:
    """Rows of a stretch side by side and in order; a stretch never lies in two tasks."""
    return facts.repartition("conv_id", "part").sortWithinPartitions("part", "conv_id", "place")


def _grouped(batches, columns: list[str], by: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first `by` columns; a group may go over several batches."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
    for key, group in groupby(rows, key=itemgetter(*range(by))):
        yield key if by > 1 else (key,), list(group)


def _batched(rows: Iterator[tuple], schema: pa.Schema, n: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


FACTS = ["conv_id", "part", "turn", "initial", "blank", "cut_off", "copies", "seen"]


def _solved(facts: DataFrame) -> DataFrame:
    """A record for each stretch: its table of costs and ranks, counts, and what its neighbours need."""
    conv, turn, long = facts.schema["conv_id"].dataType, facts.schema["turn"].dataType, T.LongType()
    counts = ["distinct_turns", "blank", "duplicate", "truncated", "illegal", "forced"]
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("part", long), T.StructField("costs", T.ArrayType(long)), T.StructField("ranks", T.ArrayType(T.IntegerType())), T.StructField("first_turn", turn), T.StructField("last_turn", turn), T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType()), *(T.StructField(c, long) for c in counts)])
    wanted = _arrow(schema)

    def run(batches):
        def out():
            for (conv_id, part), rows in _grouped(batches, FACTS, 2):
                turns = [t for _, _, t, *_ in rows if t is not None]
                initials = [r[3] for r in rows]
                blank = duplicate = truncated = forced = 0
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
                for _, _, _, initial, is_blank, cut_off, copies, seen in rows:
                    more = copies if seen else copies - 1
                    blank += copies * is_blank
                    duplicate += more * (not is_blank)
                    truncated += cut_off and not seen
                    forced += copies if is_blank else more
                    illegal += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
                table = solve_stretch([(r[3], r[5], r[4] or r[7]) for r in rows])
                yield conv_id, part, [x[0] for y in table for x in y], [x[1] for y in table for x in y], min(turns, default=None), max(turns, default=None), initials[0], initials[-1], len(set(turns)), blank, duplicate, truncated, illegal, forced

        yield from _batched(out(), wanted)

    return stretches(facts).select(*FACTS).mapInArrow(run, schema)


def _joined(solved: DataFrame) -> DataFrame:
    """A record for each stretch with its states at both ends, and the conversation's counts in its last one."""
    names = solved.columns
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([solved.schema["conv_id"], solved.schema["part"], T.StructField("state", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tail", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in counts)])
    wanted = _arrow(schema)

    def run(batches):
        def out():
            for (conv_id,), rows in _grouped(batches, names, 1):
                cost, states = join_stretches([(r[2], r[3]) for r in rows])
                known = [r for r in rows if r[8]]
                turns = sum(r[8] for r in known) - sum(a[5] == b[4] for a, b in zip(known, known[1:], strict=False))
                gaps = known[-1][5] - known[0][4] + 1 - turns if known else 0
                illegal = sum(r[12] for r in rows) + sum(a[7] + b[6] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
                sums = [sum(r[i] for r in rows) for i in (9, 10, 11)]
                cost += DELETE * sum(r[13] for r in rows)
                for i, r in enumerate(rows):
                    last = i == len(rows) - 1
                    yield conv_id, r[1], states[i], states[i + 1], TAIL[states[-1]] if last else 0, *((gaps, *sums, illegal, cost) if last else [None] * 6)

        yield from _batched(out(), wanted)

    return solved.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def _edits(facts: DataFrame, joined: DataFrame) -> DataFrame:
    """Edits in order of (place, nth): copies, edit (a letter) and the role of an inserted or rewritten turn."""
    ends = joined.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "state", "end", "tail")
    rows = facts.join(ends, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    columns = [*FACTS, "place", "state", "end", "tail"]
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("nth", T.IntegerType()), T.StructField("edit", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("new_role", T.StringType())])
    wanted = _arrow(schema)

    def run(batches):
        def out():
            for _, rows in _grouped(batches, columns, 2):
                walked = walk_back([(r[3], r[5], r[4] or r[7]) for r in rows], rows[0][9], rows[0][10])
                for r, (code, at) in zip(rows, walked, strict=True):
                    for nth, letter in enumerate(code):
                        role = ROLE[_turned(at)[0]] if letter in "IR" else None
                        yield r[8], nth, letter, r[6] if r[4] or r[7] else 1, role
                        at = _turned(at)[1] if letter == "I" else at
                    if r[6] > 1 and not (r[4] or r[7]):
                        yield r[8], len(code), "D", r[6] - 1, None
                at = rows[0][10]
                for nth in range(rows[0][11]):
                    yield rows[-1][8], 10 + nth, "I", 1, ROLE[_turned(at)[0]]
                    at = _turned(at)[1]

        yield from _batched(out(), wanted)

    return stretches(rows).select(*columns).mapInArrow(run, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (conv_id, turn, role, text, copies): the edited rows and a report of each conversation.

    Edited rows: conv_id, place, nth (their order), turn, edit (Keep, Rerole, Delete, Insert by
    initial), copies, role and text as repaired; deleted ones too. Report: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost.
    """
    small_batches(rows.sparkSession)
    rows = ordered(rows)
    facts = facts_of(rows)
    joined = materialize(_joined(_solved(facts)))
    edits = _edits(facts, joined)
    inserted = F.col("edit") == "I"
    edited = rows.select("conv_id", "place", "turn", F.col("role").alias("_role"), F.col("text").alias("_text")).join(edits, "place")
    edited = edited.select("conv_id", "place", "nth", F.when(~inserted, F.col("turn")).alias("turn"), "edit", "copies", F.coalesce("new_role", "_role").alias("role"), F.when(inserted, "").otherwise(F.col("_text")).alias("text"))
    return edited, joined.where("cost IS NOT NULL").drop("part", "state", "end", "tail")


def digests(edited: DataFrame) -> DataFrame:
    """Of each conversation the edits' initials, and the SHA-256 of the repaired rows `role:text` joined
    by newlines. A digest takes its rows one after the other: they pass through a task, never held."""
    schema = T.StructType([edited.schema["conv_id"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    wanted = _arrow(schema)

    def run(batches):
        def out():
            rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edit", "copies", "role", "text")), strict=True))
            for conv_id, group in groupby(rows, key=itemgetter(0)):
                audit, digest, between = [], hashlib.sha256(), b""
                for _, edit, copies, role, text in group:
                    audit.append(edit * copies)
                    if edit != "D":
                        digest.update(between + f"{role}:{text}".encode())
                        between = b"\n"
                yield conv_id, "".join(audit), digest.hexdigest()

        yield from _batched(out(), wanted, 256)

    text = F.when(F.col("edit") != "D", F.col("text")).alias("text")
    dealt = edited.select("conv_id", "place", "nth", "edit", "copies", "role", text).repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth")
    return dealt.mapInArrow(run, schema)


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """Per original conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    edited, report = repair(damage(rows))
    found = report.join(digests(edited).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumnRenamed("conv_id", "_conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
