"""Conversation repair against plain programs that build every audit string."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import conversations, queries

SF = "/root/testdata/sf0.001"
SHAPE = re.compile("(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string, audit string, place string, cost string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        full = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least_edits(initials, found):
    """(cost, audit, roles): every audit string with its cost, state by state; any number of inserts up to three."""
    layer = {"": (0, "", ())}  # by the last initial: audit, and what stands there

    def grown(layer):
        for _ in range(3):
            for state, (cost, audit, kept) in list(layer.items()):
                x = "a" if state == "u" else "u"
                offer = (cost + 5, audit + "I", (*kept, (x, None)))
                layer[x] = min(layer.get(x, offer), offer, key=lambda y: y[:2])
        return layer

    for i, (initial, fault) in enumerate(zip(initials, found, strict=True)):
        nxt = {}
        for state, (cost, audit, kept) in grown(dict(layer)).items():
            offers = [(state, 2, "D", kept)]
            if fault not in ("blank", "duplicate"):
                stay = 5 * (fault == "truncated")
                follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                offers += [(initial, stay, "K", (*kept, (initial, i)))] * (initial != "" and initial in follows)
                offers += [(x, 1 + stay, "R", (*kept, (x, i))) for x in follows if x != "s"]
            for to, more, letter, now in offers:
                offer = (cost + more, audit + letter, now)
                nxt[to] = min(nxt.get(to, offer), offer, key=lambda y: y[:2])
        layer = nxt
    return min((layer_end for state, layer_end in grown(layer).items() if state in ("", "a")), key=lambda y: y[:2])


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = [r[1:] for r in damaged(rows) if r[0] == conv]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        found, initials, known = faults(turns), [t[1][:1] for t in turns], {t[0] for t in turns} - {None}
        cost, audit, kept = least_edits(initials, found)
        assert SHAPE.fullmatch("".join(x for x, _ in kept))
        letters = [x for x in audit if x != "D"]
        lines = []
        for (x, i), letter in zip(kept, letters, strict=True):
            role = {"u": "user", "a": "assistant"}.get(x)
            lines.append(f"{role}:" if letter == "I" else f"{turns[i][1] if letter == 'K' else role}:{turns[i][2]}")
        counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in conversations.damage_and_repair(df).select(*COLUMNS).collect()), key=repr)


def all_edits(initials, found):
    """The cheapest, ASCII-least of all strings of edits of up to four inserts, by trying each."""
    best = None
    for macro in itertools.product("DKR", repeat=len(initials)):
        for runs in itertools.product(range(3), repeat=len(initials) + 1):
            if sum(runs) > 4 or any(m != "D" and f in ("blank", "duplicate") for m, f in zip(macro, found, strict=True)):
                continue
            audit = "".join("I" * n + m for n, m in zip(runs, macro, strict=False)) + "I" * runs[-1]
            cost = sum({"D": 2, "K": 0, "R": 1}[m] + 5 * (m != "D" and f == "truncated") for m, f in zip(macro, found, strict=True)) + 5 * sum(runs)
            slots = []
            for n, m, x in zip(runs, macro, initials, strict=False):
                slots += [["u", "a"]] * n + ([[x]] if m == "K" else [["u", "a"]] if m == "R" else [])
            slots += [["u", "a"]] * runs[-1]
            if any(SHAPE.fullmatch("".join(c)) for c in itertools.product(*slots)):
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_least_edits_of_short_conversations_are_least_of_all(n):
    kinds = [(x, f) for x in ("s", "u", "a", "t") for f in ("", "truncated")] + [("u", "blank")]
    for turns in itertools.product(kinds, repeat=n):
        if n == 3 and sum(f == "truncated" for _, f in turns) > 1:
            continue
        initials, found = [x for x, _ in turns], [f for _, f in turns]
        want = all_edits(initials, found)
        assert least_edits(initials, found)[:2] == want
        rows = [(x, f == "truncated", f == "blank") for x, f in turns]
        # as one stretch, and as stretches of one row each
        for cut in ([rows], [[r] for r in rows]) if rows else ([],):
            tables = [conversations.solve_stretch(part) for part in cut]
            cost, states = conversations.join_stretches([([x[0] for y in t for x in y], [x[1] for y in t for x in y]) for t in tables])
            audit = "".join(code for part, a, b in zip(cut, states, states[1:], strict=False) for code, _ in conversations.walk_back(part, a, b))
            assert (cost + 2 * found.count("blank"), audit + "I" * conversations.TAIL[states[-1]]) == want


def test_whole_table_by_brute_force(spark):
    df = queries.read(spark, SF, "conversations")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert queries.op12_conversation_repair(spark, SF).columns == COLUMNS


def awkward(spark):
    long = "word " * 50_000
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 2, "assistant", "a."), (2, 1, "tool", long), (2, 1, "", "x."), (2, 5, "system", "end!"), (2, 9, "uncle", "\tq?\n")]
    rows += [(3, i, r, t) for i, (r, t) in enumerate([("system", "s."), ("system", "s."), ("assistant", "hello."), ("user", "x"), ("user", "x"), ("assistant", "Ünï…")])]
    rows += [(4, 7, "user", "same.")] * 30 + [(5, 0, "user", "")]
    rows += [(c, t, ("user", "assistant", "system", "tool")[(c * 7 + t * t) % 4], f"t{(c + t) % 5}{'.' * (t % 3)}") for c in range(10, 40) for t in range(c % 9)]
    rows += [(9, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"turn {t % 50}{'.' * (t % 3)}") for t in range(900)]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], ROWS), rows


def test_awkward_rows_and_a_conversation_over_many_tasks(spark):
    df, rows = awkward(spark)
    want = brute(rows)
    assert got(df.repartition(5)) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        ordered = conversations.ordered(conversations.damage(df))
        assert ordered.where("conv_id = 9").select("part").distinct().count() > 5
        assert got(df) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edited_rows_are_whole_texts_in_order(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Yes."), (1, 1, "user", "Cut"), (1, 2, "user", "More?"), (2, 0, "user", "Only?")], "conv_id long, turn long, role string, text string")
    edited, report = conversations.repair(df.withColumn("copies", F.lit(1)))
    rows = [tuple(r) for r in edited.orderBy("conv_id", "place", "nth").select("conv_id", "turn", "edit", "role", "text").collect()]
    assert rows == [(1, 0, "R", "user", "Yes."), (1, 1, "D", "user", "Cut"), (1, 2, "R", "assistant", "More?"), (2, 0, "D", "user", "Only?")]
    assert {r["conv_id"]: r["cost"] for r in report.collect()} == {1: 4, 2: 2}


def test_no_rows(spark):
    assert conversations.damage_and_repair(queries.read(spark, SF, "conversations").where(F.lit(False))).count() == 0
