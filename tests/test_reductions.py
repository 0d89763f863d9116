"""Exact reductions of parts without a hub."""

from __future__ import annotations

import random
from collections import defaultdict

import brute
from quantaint.operators import components
from quantaint.operators.components import general_gamma, hitting_bounds
from quantaint.operators.hitting import tuple_counts
from quantaint.plans.icqa import responsibility_weights
from test_hitting import family_frame

CHAIN = [{"a1", "b1"}, {"b1", "c1"}, {"c1", "d1"}]


def test_reduced_parts_are_exact(spark):
    families = {
        # Chains under several names, as the hash decides a greedy choice.
        **{f"chain{i}": [{f"{x}{i}" for x in "".join(y[0] for y in e)} for e in CHAIN] for i in range(12)},
        "superset": [*CHAIN, {"a1", "b1", "x1"}],
        "tree": [{"r1", "a1"}, {"r1", "b1"}, {"a1", "c1"}, {"b1", "d1"}, {"b1", "e1"}],
    }
    rows = general_gamma(family_frame(spark, families), ["g"]).collect()
    want = {(g, t): v for g, edges in families.items() for t, v in brute.gamma(edges).items()}
    assert {(r.g, r.relation + r.pk) for r in rows} == set(want)
    for r in rows:
        exact = want[r.g, r.relation + r.pk]
        assert r.gamma_low <= exact <= r.gamma
        if r.g.startswith("chain"):
            assert (r.gamma, r.gamma_low, r.status) == (exact, exact, "OPTIMAL")


def test_weights_carry_the_status(spark):
    rows = [("Q4", "BRAZIL", "x", [("nation", "1"), ("customer", "1")])]
    schema = "qname string, answervalue string, comp string, tuples array<struct<relation: string, pk: string>>"
    supports = spark.createDataFrame(rows, schema)
    weights = responsibility_weights(tuple_counts(supports, ["qname", "answervalue"]), supports).collect()
    assert weights and all((r.status, r.gamma_low) == ("OPTIMAL", r.gamma) for r in weights)


def cycle(name: str, n: int) -> list[set]:
    return [{f"{name}{i}", f"{name}{(i + 1) % n}"} for i in range(n)]


def test_cycles_are_optimal_for_every_tuple(spark):
    families = {f"c{n}.{i}": cycle(f"{'abcd'[i]}", n) for n in (3, 4, 5, 7) for i in range(4)}
    # A cycle beside a chain in one family, and one with a tail, which is no cycle.
    families["beside"] = [*cycle("a", 5), {"x1", "y1"}, {"y1", "z1"}, {"z1", "w1"}]
    families["tail"] = [*cycle("a", 5), {"a0", "t1"}, {"t1", "u1"}]
    sets = family_frame(spark, families)
    want = {(g, t): v for g, edges in families.items() for t, v in brute.gamma(edges).items()}
    for r in general_gamma(sets, ["g"]).collect():
        exact = want.pop((r.g, r.relation + r.pk))
        assert r.gamma_low <= exact <= r.gamma
        if r.g.startswith("c"):
            assert (r.gamma, r.status) == (exact, "OPTIMAL")
    assert not want
    for r in hitting_bounds(sets, ["g"]).collect():
        edges = families[r.g]
        assert r.hitting_low == r.hitting_high == brute.min_hitting(edges) and r.status == "OPTIMAL"
        assert (r.n_sets, r.n_nodes) == (len(edges), len(set().union(*edges)))


def test_bounds_of_dense_families_hold(spark):
    rng = random.Random(3)
    families = {}
    for i in range(10):
        nodes = [f"{x}1" for x in "abcdefgh"]
        families[f"r{i}"] = [set(rng.sample(nodes, rng.choice((2, 2, 3)))) for _ in range(11)]
    # Sets of a projective plane: shares bound them by 7 / 3, no two are apart.
    families["plane"] = [{f"{x}1" for x in line} for line in ("abc", "ade", "afg", "bdf", "beg", "cdg", "cef")]
    for r in hitting_bounds(family_frame(spark, families), ["g"]).collect():
        exact = brute.min_hitting(families[r.g])
        assert r.hitting_low <= exact <= r.hitting_high
        if r.g == "plane":
            assert (r.hitting_low, exact) == (3, 3)


def test_least_sets_and_dominated_tuples_by_definition(spark):
    """Sets of up to six tuples, equal sets, and one frequent tuple in nearly all of them."""
    rng = random.Random(3)
    families = {
        f"f{i}": [
            {"h"} | set(rng.sample("abcdefg", rng.randint(0, 5))) if rng.random() < 0.7 else set(rng.sample("abcdefg", 2))
            for _ in range(12)
        ]
        for i in range(25)
    }
    rows = [(g, f"m{i:02}", t) for g, sets in families.items() for i, e in enumerate(sets) for t in e]
    members = spark.createDataFrame(rows, "comp string, mis_id string, tid string")
    least, rest = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for r in components._least_sets(members, ["comp"]).collect():
        least[r.comp][r.mis_id].add(r.tid)
    for r in components._without_dominated(members, ["comp"]).collect():
        rest[r.comp][r.tid].add(r.mis_id)
    for g, sets in families.items():
        named = {f"m{i:02}": e for i, e in enumerate(sets)}
        assert dict(least[g]) == {
            m: e for m, e in named.items() if not any(f < e or (f == e and n < m) for n, f in named.items())
        }
        inside = {t: {m for m, e in named.items() if t in e} for e in sets for t in e}
        assert dict(rest[g]) == {
            t: e for t, e in inside.items() if not any(e < f or (e == f and u < t) for u, f in inside.items())
        }
