from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import brute
from quantaint.operators.constraints import DenialConstraint
from quantaint.operators.measures import gamma_details, normalise_measures, rim_by_constraint
from quantaint.operators.violations import set_counts
from quantaint.plans import registered


def test_totals_follow_from_the_number_of_sets(spark, small):
    exp = registered.experiment(spark, small)
    sets = {}
    for r in set_counts(exp.violations).collect():
        sets.setdefault(r.db_id, {})[r.dc] = r.mis
    sums = exp.wide_measures.groupBy("db_id").agg(
        F.sum("cim").alias("cim"),
        F.sum("pim").alias("pim"),
        F.sum("rim").alias("rim"),
        F.max("cbm").alias("cbm"),
    )
    per_set = {"DC1": 1, "DC2": 4, "DC3": 4, "DC4": 6}
    for r in sums.collect():
        own = sets[r.db_id]
        assert r.rim == pytest.approx(sum(own.values()))
        assert r.pim == pytest.approx(sum(own.values()))
        assert r.cim == pytest.approx(sum(per_set[dc] * n for dc, n in own.items()))
        assert r.cbm <= len(own)


def test_weights_are_shares(spark, small):
    weights = registered.experiment(spark, small).weights
    totals = weights.groupBy("qname", "answervalue").agg(
        F.sum("phi").alias("phi"), F.min("rho").alias("low"), F.max("rho").alias("high")
    )
    rows = totals.collect()
    assert rows
    for r in rows:
        assert r.phi == pytest.approx(1.0)
        assert 0 < r.low <= r.high <= 1


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="missing columns"):
        normalise_measures(spark.range(1))


def test_gamma_of_groups_with_several_hubs(spark):
    """A constraint whose hub the other tuple's key does not determine: both kinds of groups."""
    linked = DenialConstraint("X", ("part", "supplier"), "true", "part", {"part": 1.0, "supplier": 1.0})
    assert not linked.hub_is_determined
    # Scenario one: two parts share a supplier; two: one part with two suppliers.
    families = {
        "one": [("p1", "s1"), ("p2", "s1"), ("p2", "s2"), ("p3", "s3")],
        "two": [("p1", "s1"), ("p1", "s2")],
    }
    rows = [
        (g, "X", f"{p}|{s}", p, [("part", p), ("supplier", s)]) for g, sets in families.items() for p, s in sets
    ]
    schema = (
        "db_id string, dc string, mis_id string, comp string, tuples array<struct<relation: string, pk: string>>"
    )
    details = gamma_details(spark.createDataFrame(rows, schema), 2, {"X": linked})
    got = {(r.db_id, r.pk): r for r in rim_by_constraint(details).collect()}
    for g, sets in families.items():
        want = brute.gamma([set(x) for x in sets])
        shares = {t: 1 / (1 + v) for t, v in want.items()}
        for t, v in want.items():
            r = got.pop((g, t))
            assert (r.gamma, r.gamma_low, r.status) == (v, v, "OPTIMAL")
            assert (r.n_nodes, r.n_edges) == (len(want), sum(t not in x for x in sets))
            assert r.rim == pytest.approx(len(sets) * shares[t] / sum(shares.values()))
    assert not got
