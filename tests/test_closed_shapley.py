from __future__ import annotations

import random
from math import comb

import pytest
from pyspark.sql import functions as F

import brute
from quantaint.operators.closed_shapley import closed_shapley, hierarchical
from quantaint.operators.hitting import tuple_counts
from quantaint.operators.shapley import exact_shapley
from quantaint.operators.supports import ANSWER, QUERIES
from quantaint.plans import registered

SCHEMA = "qname string, answervalue string, comp string, tuples array<struct<relation: string, pk: string>>"


def forest(rng: random.Random, qname: str, roots: int, stars: int, leaves: int) -> list[list[tuple[str, str]]]:
    """Supports of one answer as lists of (relation, pk), the chain's upper levels first."""
    chain, found, n = QUERIES[qname].chain, [], 0
    for root in range(roots if len(chain) == 3 else 1):
        for star in range(rng.randint(1, stars) if len(chain) > 1 else 1):
            for _ in range(rng.randint(1, leaves)):
                n += 1
                keys = (str(root), f"{root}.{star}", str(n))[-len(chain) :]
                found.append(list(zip(chain, keys, strict=True)))
    return found


def values(spark, answers: dict[tuple[str, str], list]) -> dict:
    rows = [(q, a, "", t) for (q, a), found in answers.items() for t in found]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = closed_shapley(df).collect()
    assert len(found) == len({(r.qname, r.answervalue, r.relation, r.pk) for r in found})
    return {(r.qname, r.answervalue, (r.relation, r.pk)): r.phi for r in found}


def test_covered_queries():
    assert hierarchical() == ["Q1", "Q2", "Q3"]
    assert [QUERIES[q].chain for q in hierarchical()] == [
        ("orders",),
        ("orders", "lineitem"),
        ("nation", "customer", "orders"),
    ]


def test_equals_enumeration_of_all_orders(spark):
    rng = random.Random(4)
    answers = {
        (q, f"{i}"): forest(rng, q, roots=2, stars=2, leaves=2) for q in hierarchical() for i in range(8)
    }
    answers = {k: v for k, v in answers.items() if len({t for s in v for t in s}) <= 8}
    got = values(spark, answers)
    assert len(answers) > 15
    for (q, a), found in answers.items():
        for node, phi in brute.shapley([set(map(tuple, s)) for s in found]).items():
            assert got.pop((q, a, node)) == pytest.approx(phi, abs=1e-13)
    assert not got


def by_counts(stars: list[int]) -> list[tuple[float, float]]:
    """(centre, leaf) values of a forest of stars, from exact counts of coalitions by size."""
    def times(p, q):
        out = [0] * (len(p) + len(q) - 1)
        for i, x in enumerate(p):
            for j, y in enumerate(q):
                out[i + j] += x * y
        return out

    n = sum(stars) + len(stars)
    found = []
    for at, k in enumerate(stars):
        rest = [1]
        for other in stars[:at] + stars[at + 1 :]:
            held = [0, *[comb(other, i) for i in range(other + 1)]]
            held[other] += 1
            rest = times(rest, held)
        centre = times(rest, [comb(k, i) for i in range(k)])
        leaf = times(rest, [0] * (k - 1) + [1])
        found.append(tuple(sum(c / (n * comb(n - 1, s)) for s, c in enumerate(p)) for p in (centre, leaf)))
    return found


def test_equals_exact_counts_for_many_tuples(spark):
    rng = random.Random(9)
    stars = [rng.randint(1, 6) for _ in range(60)] + [70]
    supports, n = [], 0
    for star, k in enumerate(stars):
        for _ in range(k):
            n += 1
            supports.append([("orders", str(star)), ("lineitem", str(n))])
    got = values(spark, {("Q2", "AIR"): supports})
    n = 0
    for star, (k, (centre, leaf)) in enumerate(zip(stars, by_counts(stars), strict=True)):
        assert got["Q2", "AIR", ("orders", str(star))] == pytest.approx(centre, rel=1e-9)
        for _ in range(k):
            n += 1
            assert got["Q2", "AIR", ("lineitem", str(n))] == pytest.approx(leaf, rel=1e-9)
    assert sum(got.values()) == pytest.approx(1, abs=1e-12)


def test_values_of_very_large_answers_sum_to_one(spark):
    n = 300_000
    node = F.struct(F.lit("orders").alias("relation"), F.col("id").cast("string").alias("pk"))
    line = F.struct(F.lit("lineitem").alias("relation"), F.concat("id", F.lit("-"), "j").alias("pk"))
    one = spark.range(n).select(F.lit("Q1").alias("qname"), F.lit("1").alias("answervalue"), F.lit("").alias("comp"), F.array(node).alias("tuples"))
    two = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.col("id") % 4)).alias("j")).select(
        F.lit("Q2").alias("qname"), F.lit("2").alias("answervalue"), F.lit("").alias("comp"), F.array(node, line).alias("tuples")
    )
    found = closed_shapley(one.unionByName(two))
    for r in found.groupBy("qname").agg(F.sum("phi").alias("all"), F.min("phi").alias("low"), F.max("phi").alias("high")).collect():
        assert r.all == pytest.approx(1, abs=1e-9) and r.low > 0
        if r.qname == "Q1":
            assert r.low == pytest.approx(1 / n, rel=1e-9) and r.high == pytest.approx(1 / n, rel=1e-9)


def test_equals_the_exact_method_on_the_tables(spark, small):
    sets = registered.experiment(spark, small.replace("sf0.001", "sf0.01")).supports
    exact = exact_shapley(sets, tuple_counts(sets, ANSWER), 100).filter(F.col("qname").isin(hierarchical()))
    got = {tuple(r)[:4]: r.phi for r in closed_shapley(sets).collect()}
    small_answers = exact.collect()
    assert len(small_answers) > 30
    for r in small_answers:
        assert got[tuple(r)[:4]] == pytest.approx(r.phi, abs=1e-12)
