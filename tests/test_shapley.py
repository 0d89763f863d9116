from __future__ import annotations

import random
from math import sqrt

import pytest

import brute
from quantaint.operators.hitting import tuple_counts
from quantaint.operators.shapley import exact_shapley, sampled_shapley, shapley_weights
from quantaint.operators.supports import ANSWER

SCHEMA = (
    "qname string, answervalue string, comp string, "
    "tuples array<struct<relation: string, pk: string>>"
)


def frame(spark, families):
    rows = [
        ("Q", name, "", [(node[0], node[1:]) for node in sorted(edge)])
        for name, edges in families.items()
        for edge in edges
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df, tuple_counts(df, ANSWER)


def values(df):
    return {(r.answervalue, r.relation + r.pk): r.phi for r in df.collect()}


def families(seed: int) -> dict[str, list[set]]:
    rng = random.Random(seed)
    found = {"stars": [{"o1", "l11"}, {"o1", "l12"}, {"o2", "l21"}]}
    for i in range(12):
        nodes = [f"t{k}" for k in range(rng.randint(1, 6))]
        found[f"r{i}"] = [
            set(rng.sample(nodes, rng.randint(1, min(3, len(nodes)))))
            for _ in range(rng.randint(1, 5))
        ]
    return found


def test_exact_equals_all_orders(spark):
    cases = families(3)
    df, counts = frame(spark, cases)
    got = values(exact_shapley(df, counts, 100))
    for name, edges in cases.items():
        for node, phi in brute.shapley(edges).items():
            assert got[name, node] == pytest.approx(phi, abs=1e-12)
    assert got["stars", "o1"] == pytest.approx(11 / 30)


def test_samples_estimate_all_orders(spark):
    cases = families(5)
    df, counts = frame(spark, cases)
    samples = 4000
    got = values(sampled_shapley(df, counts, 100, widest=3, exact_tuples=0, samples=samples))
    worst = 0.0
    for name, edges in cases.items():
        want = brute.shapley(edges)
        assert sum(got[name, n] for n in want) == pytest.approx(1.0)
        for node, phi in want.items():
            error = sqrt(max(phi * (1 - phi), 1e-9) / samples)
            worst = max(worst, abs(got[name, node] - phi) / error)
    assert worst < 4.5


def test_method_follows_number_of_tuples(spark):
    cases = {"few": [{"a1"}, {"a2"}], "many": [{f"a{i}"} for i in range(16)]}
    df, counts = frame(spark, cases)
    rows = shapley_weights(df, counts, 100, widest=1, samples=500).collect()
    assert {(r.answervalue, r.method) for r in rows} == {("few", "exact"), ("many", "sampled")}
    assert len(rows) == 18
