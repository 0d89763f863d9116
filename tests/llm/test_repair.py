from __future__ import annotations

import hashlib
import heapq
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantaint.llm import oracle, registered, repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PUT = {0: "u", 1: "u", 2: "a", 3: "u"}


def cheapest(initials: str, faults: str) -> tuple[int, str]:
    """Least (cost, edits) by growing paths in that order."""
    heap, closed = [(0, "", 0, 0)], set()
    while True:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(initials) and state in (0, 3):
            return cost, edits
        if (i, state) in closed:
            continue
        closed.add((i, state))
        put = NEXT[state, PUT[state]]
        heapq.heappush(heap, (cost + 2, edits + "I", i, put))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state))
            if faults[i] not in "bd":
                more = faults[i] == "t"
                heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, put))
                if (state, initials[i]) in NEXT:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, NEXT[state, initials[i]]))


def expected(rows: list[tuple], damage: bool = True) -> dict:
    """Every conversation of (conv_id, turn, role, text), restated row by row."""
    def spaced(x):
        return " " if x is None else str(x)

    convs: dict = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        kind = crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20 if damage else 19
        role, text = spaced(role), spaced(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = "", set()
        for _, role, text in kept:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults += "b" if not end else "d" if (role, text) in seen else "." if end[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = "".join(role[:1] if role[:1] in ("s", "u", "a") else "x" for _, role, _ in kept)
        cost, audit = cheapest(initials, faults)
        said, state, at = [], 0, 0
        for edit in audit:
            _, role, text = kept[at] if edit != "I" else (0, "", "")
            at += edit != "I"
            if edit != "D":
                initial = role[:1] if edit == "K" else PUT[state]
                state = NEXT[state, initial]
                said.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
        turns = [t for t, _, _ in kept if t is not None]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(x) for x in "bdt"],
            sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)),
            cost,
            audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return found


def repaired(spark, rows, damage=True, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit(1), "edits": F.lit("x"), "kind": F.lit("y")})
    return {r[0]: tuple(r)[1:] for r in repair.repair_conversations(df.repartition(parts), damage).collect()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("...bdt")), max_size=16), st.sampled_from([2, 5, 32]))
def test_prices_give_the_least_string_of_cheapest_edits(rows, segment):
    initials, faults = "".join(r[0] for r in rows), "".join(r[1] for r in rows)
    assert repair.cheapest_edits(initials, faults, segment) == cheapest(initials, faults)[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("..bdt")), min_size=1, max_size=10))
def test_converged_prices_are_feasible_and_tight_on_the_path(rows):
    lattice = repair.Lattice("".join(r[0] for r in rows), "".join(r[1] for r in rows), repair.CLOSING_COSTS)
    edits, _ = lattice.trace(0)
    for node, arcs in enumerate(lattice.arcs):
        assert all(lattice.prices[node] <= cost + lattice.prices[j] for _, cost, j in arcs)
    node, total = 0, 0
    for letter in [*edits, ""]:
        cost, after = next((c, j) for x, c, j in lattice.arcs[node] if x == letter)
        assert lattice.prices[node] == cost + lattice.prices[after]
        node, total = after, total + cost
    assert node == lattice.end and total == lattice.prices[0] - lattice.prices[lattice.end]


def test_unreachable_states_are_priced_out():
    found = repair.distances("ua", "..")
    assert found[4 * 0 + 2] > 0 and found[4 * 2 + 0] >= repair._FAR and found[4 * 0 + 1] >= repair._FAR
    assert found[4 * 0 + 3] == 0 and found[4 * 1 + 1] == 2 * repair.DELETE


def test_nulls_ties_repeats_and_long_conversations(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}{'.!?'[t % 3] if t % 5 else ''}") for t in range(700)]
    rows += [(2, 1, "system", "Be kind."), (2, 1, "system", "Be kind."), (2, 2, "user", " \t"), (2, 3, "", "x")]
    rows += [(3, None, None, None), (3, None, "user", "a."), (3, 4, "assistant", None), (3, 9, "tool", "b!")]
    rows += [(None, 1, "user", "c?"), (None, 2, "assistant", "d" * 2_000_000 + "."), (None, None, "user", "é.")]
    rows += [(4, 0, "user", "")] * 3 + [(5, 7, "user", "Alone.")] + [(6, 1, "sys", "?"), (6, 1, "abc", "?")]
    for damage in (True, False):
        assert repaired(spark, rows, damage) == expected(rows, damage)


def test_conversation_that_loses_all_rows_and_empty_table(spark):
    lost = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(lost, 0, "user", "a.")]) == {lost: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repaired(spark, []) == {}


def test_query_equals_brute_force_and_statement(spark, small, duck):
    found = {r[0]: tuple(r)[1:] for r in registered.op12_conversation_repair(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found == expected([tuple(r) for r in rows])
    stated = duck.execute(oracle.statements()["op12_conversation_repair"]).fetchall()
    assert found == {r[0]: tuple(r[1:]) for r in stated}


@pytest.mark.parametrize("id_type", ["string", "int"])
def test_ids_of_other_types(spark, id_type):
    rows = [(c, t, "user", f"{c} {t}.") for c in range(3) for t in range(80)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv_id", F.col("conv_id").cast(id_type))
    found = {str(r[0]): tuple(r)[1:] for r in repair.repair_conversations(df).collect()}
    assert found == {str(k): v for k, v in expected(rows).items()}
