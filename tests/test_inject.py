from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quantaint.functions.hashing import MULTIPLIER, SHIFT, P
from quantaint.operators.constraints import (
    CONSTRAINTS,
    as_violation_sets,
    membership,
    shared_pass_rows,
)
from quantaint.operators import inject as injecting
from quantaint.operators.inject import (
    INJECTIONS,
    draw_number,
    eligible_supplies,
    near_eligible_supplies,
    inject,
    injection_log,
    violated_relation,
)
from quantaint.operators.scenarios import Scenario, db_ids
from quantaint.operators.violations import violation_sets
from quantaint.schema import KEYS
from quantaint.sources.testdata import clean_database

SCENARIOS = [
    Scenario("x", "subsetA", 0.001, 1),
    Scenario("x", "subsetB", 0.05, 1),
    Scenario("x", "subsetB", 0.05, 2),
]


def hash_of(key: tuple, draw: int) -> int:
    digest = hashlib.md5(",".join(map(str, key)).encode()).hexdigest()
    low, high = int(digest[:15], 16), int(digest[16:31], 16)
    w = [low % P, low >> 31, high % P, high >> 31]

    def stirred(x: int) -> int:
        return (x ^ (x >> SHIFT)) * MULTIPLIER % P

    return stirred((w[0] * draw + w[1]) % P) * 2**31 + stirred((w[2] * draw + w[3]) % P)


def picks(overlay, dc: str, index: int) -> set:
    relation = INJECTIONS[dc].relation
    rows = overlay.touched[relation].filter(
        (F.col("db_id") == db_ids(overlay.scenarios)[index]) & F.col(f"hit_{dc.lower()}")
    )
    return {tuple(r) for r in rows.select(*KEYS[relation]).collect()}


@pytest.mark.parametrize("cut_rows", [10**9, 500, 1])
def test_draw_is_the_head_of_the_hash_order(spark, small, cut_rows):
    """Directly, with one narrowing pass and with two."""
    db = clean_database(spark, small)
    overlay = inject(db, SCENARIOS, cut_rows)
    orders = {r.o_orderkey: r.o_orderstatus for r in db["orders"].collect()}
    lines = [(r.l_orderkey, r.l_linenumber, r.l_linestatus) for r in db["lineitem"].collect()]
    eligible = {
        "DC1": [(o, n) for o, n, _ in lines],
        "DC2": [(o, n) for o, n, _ in lines],
        "DC3": [(o, n) for o, n, s in lines if orders[o] == "F" and s == "F"],
        "DC4": [(r.ps_partkey, r.ps_suppkey) for r in db["partsupp"].collect()],
    }
    for index, scenario in enumerate(SCENARIOS):
        for dc in scenario.constraints:
            base = db.rows(INJECTIONS[dc].relation)
            n = max(1, int(base * scenario.ratio))
            k = draw_number(dc, scenario.seed)
            want = sorted(eligible[dc], key=lambda key: (hash_of(key, k), key))[:n]
            assert picks(overlay, dc, index) == set(want)


def test_too_few_eligible_rows_takes_all(spark, small):
    """Also when the first pass over small hashes cannot reach the cut."""
    db = clean_database(spark, small)
    few = db.replacing(orders=db["orders"].filter("o_orderkey % 50 = 0"))
    overlay = inject(few, [Scenario("x", "subsetB", 0.1, 3)], cut_rows=100)
    log = {r.dc: (r.requested, r.applied) for r in injection_log(overlay).collect()}
    linked = few["lineitem"].join(few["orders"], F.expr("l_orderkey = o_orderkey"))
    assert log["DC1"] == (600, 600)
    assert log["DC2"] == (600, linked.count())
    assert log["DC3"] == (600, linked.filter("o_orderstatus = 'F'").count())


def dirty(db):
    """A base that violates all constraints before any injection."""
    lines = db["lineitem"].withColumns(
        {
            "l_receiptdate": F.expr(
                "if(l_orderkey % 7 = 0, date_sub(l_shipdate, 2), l_receiptdate)"
            ),
            "l_commitdate": F.expr(
                "if(l_orderkey % 5 = 0, date'1980-01-01', l_commitdate)"
            ),
            "l_linestatus": F.expr("if(l_linenumber = 2, 'O', l_linestatus)"),
        }
    )
    supplies = db["partsupp"].withColumn(
        "ps_availqty", F.expr("if(ps_partkey % 9 = 0, -5, ps_availqty)")
    )
    return db.replacing(
        lineitem=lines,
        partsupp=supplies,
        orders=db["orders"].filter("o_orderkey % 11 <> 0"),
    )


@pytest.mark.parametrize("dcs", [("DC1", "DC2", "DC3", "DC4"), ("DC2",), ("DC1", "DC4")])
def test_sets_equal_those_of_full_copies(spark, small, dcs):
    db = dirty(clean_database(spark, small))
    overlay = inject(db, SCENARIOS[1:])
    got = membership(violation_sets(overlay, dcs), ("db_id",))
    full = {rel: violated_relation(overlay, rel) for rel in ("lineitem", "partsupp")}
    frames = []
    for dc in dcs:
        c = CONSTRAINTS[dc]
        tables = {**db, c.varying_relation: full[c.varying_relation]}
        rows = shared_pass_rows(tables, [c], ("db_id",))
        frames.append(membership(as_violation_sets(rows, [c], ("db_id",)), ("db_id",)))
    want = frames[0]
    for frame in frames[1:]:
        want = want.unionByName(frame)
    columns = ["db_id", "dc", "mis_id", "relation", "pk"]
    got_rows = sorted(map(tuple, got.select(*columns).collect()))
    assert got_rows == sorted(map(tuple, want.select(*columns).collect()))
    assert {r[1] for r in got_rows} == set(dcs)


def test_each_injection_adds_its_violations(spark, small):
    overlay = inject(clean_database(spark, small), SCENARIOS)
    applied = {(r.db_id, r.dc): r.applied for r in injection_log(overlay).collect()}
    counts = violation_sets(overlay).groupBy("db_id", "dc").count().collect()
    found = {(r.db_id, r.dc): r["count"] for r in counts}
    assert set(found) == set(applied)
    for key, n in applied.items():
        assert found[key] >= n if key[1] == "DC4" else found[key] == n


def test_bitmap_changes_no_supply(spark, small, monkeypatch):
    """Near supplies by bitmaps of any fill are the eligible ones; none gives none."""
    db = clean_database(spark, small)
    for share, buckets, bits in ((7, 8192, 16), (2, 1, 16), (1, 8192, 600)):
        monkeypatch.setattr(injecting, "BITMAP_BUCKETS", buckets)
        monkeypatch.setattr(injecting, "PAIR_BITS", bits * 64)
        near = db["partsupp"].filter(F.col("ps_partkey") % share == 0)
        want = sorted(map(tuple, eligible_supplies(db, near).select(*KEYS["partsupp"]).collect()))
        assert want
        assert sorted(map(tuple, near_eligible_supplies(db, near).select(*KEYS["partsupp"]).collect())) == want
    assert near_eligible_supplies(db, db["partsupp"].limit(0)).isEmpty()
