"""Shapley values of hierarchical queries in closed form, for any number of tuples.

In a hierarchical query every tuple of a support fixes the next one: lineitem, order; or order,
customer, nation. Supports of an answer are then the paths of a forest, and "the coalition meets
every support" splits by subtrees. If each tuple is present with chance x, a node holds with

    h = x + (1 - x) * product of its children's h        (a leaf: h = x)

and the answer with the product over the roots. A tuple's Shapley value is the integral over x of
its effect on that product. Only logarithms of h are summed, at fixed points x, so an answer is one
mergeable aggregate: stars (the lowest nodes that have leaves) count by their number of leaves, and
everything after that works on one row per (answer, root, number of leaves, point).

With x = 1 / (1 + exp(-u)) the integrand is analytic around the real line and decays at both ends,
so that equal steps in u converge exponentially, at a pace that does not depend on the size.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaint.operators.supports import ANSWER, QUERIES, QuerySpec
from quantaint.sources.store import keep

# The integrand falls below 1e-16 outside, for any answer of fewer than e^40 tuples. Stars of two levels
# fall off with exp(-n exp(-2u)), analytic for |Im u| < pi / 4: an error near exp(-pi^2 / (2 STEP)).
STEP, FIRST, LAST = 0.125, -37.0, 80.0
_POINTS = round((LAST - FIRST) / STEP)
_LEVELS = (1, 2, 3)


def hierarchical(specs: Mapping[str, QuerySpec] = QUERIES) -> list[str]:
    """Names of the queries this form covers: chains of at most three relations."""
    return [name for name, spec in specs.items() if spec.chain and len(spec.chain) <= len(_LEVELS)]


def _level_relation(specs: Mapping[str, QuerySpec], level: int) -> Column:
    """Relation of a level by query; chains are hung from their leaves, upper levels may be missing."""
    found = F.lit(None).cast("string")
    for name in hierarchical(specs):
        chain = (None,) * (len(_LEVELS) - len(specs[name].chain)) + specs[name].chain
        found = F.when(F.col("qname") == name, F.lit(chain[level - 1])).otherwise(found)
    return found


def _paths(supports: DataFrame, specs: Mapping[str, QuerySpec]) -> DataFrame:
    """(qname, answervalue, r1..r3, p1..p3): relation and key of each level, empty where it is missing."""
    named = supports.filter(F.col("qname").isin(hierarchical(specs))).select(
        *ANSWER, "tuples", *[_level_relation(specs, i).alias(f"r{i}") for i in _LEVELS]
    )
    keys = [
        F.coalesce(F.expr(f"get(filter(tuples, t -> t.relation = r{i}), 0).pk"), F.lit("")).alias(f"p{i}")
        for i in _LEVELS
    ]
    return named.select(*ANSWER, *[f"r{i}" for i in _LEVELS], *keys)


def _holds(below: Column, present: Column) -> Column:
    """Log of h for a node whose children's product has the log ``below``; a missing node adds nothing."""
    near_one = F.log1p(F.exp("b") * F.expm1(below))
    h = F.when(F.col("a") < log(0.5), F.log(F.exp("a") + F.exp(F.col("b") + below))).otherwise(near_one)
    return F.when(present, h).otherwise(below)


def closed_shapley(supports: DataFrame, specs: Mapping[str, QuerySpec] = QUERIES) -> DataFrame:
    """(qname, answervalue, relation, pk, phi) of every tuple of the hierarchical queries.

    Answers may have several roots (nations of one name). A support has one leaf, which no other
    support of the answer has.
    """
    paths = _paths(supports, specs)
    top, mid = F.col("r1").isNotNull(), F.col("r2").isNotNull()
    stars = keep(
        paths.groupBy(*ANSWER, "r1", "r2", "r3", "p1", "p2").agg(F.count(F.lit(1)).alias("leaves")), "stars"
    )
    u = F.lit(FIRST) + STEP * F.col("point")
    grid = (
        stars.groupBy(*ANSWER, "r1", "r2", "p1", "leaves")
        .agg(F.count(F.lit(1)).alias("alike"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(_POINTS))).alias("point"))
        # Logs of x and of 1 - x.
        .withColumns({"a": -F.log1p(F.exp(-u)), "b": -F.log1p(F.exp(u))})
        .withColumn("star", _holds(F.col("leaves") * F.col("a"), mid))
    )
    roots = (
        grid.groupBy(*ANSWER, "r1", "p1", "point", "a", "b")
        .agg(F.sum(F.col("alike") * F.col("star")).alias("below"))
        .withColumn("root", _holds(F.col("below"), top))
    )
    whole = roots.groupBy(*ANSWER, "point").agg(F.sum("root").alias("whole"))
    roots = keep(roots.join(whole, [*ANSWER, "point"]), "root-points")
    weight = log(STEP) + F.col("a") + F.col("b")
    others = F.col("whole") - F.col("root")
    of_roots = (
        roots.filter(top)
        .groupBy(*ANSWER, "r1", "p1")
        .agg(F.sum(F.exp(weight + others) * -F.expm1("below")).alias("phi"))
    )
    absent = F.when(top, F.col("b")).otherwise(0.0)
    beside = weight + others + absent + F.col("below") - F.col("star")
    center_absent = F.when(mid, F.col("b")).otherwise(0.0)
    of_stars = (
        grid.drop("a", "b", "r1")
        .join(roots, [*ANSWER, "p1", "point"])
        .groupBy(*ANSWER, "p1", "leaves")
        .agg(
            F.sum(F.exp(beside) * -F.expm1(F.col("leaves") * F.col("a"))).alias("center_phi"),
            F.sum(F.exp(beside + center_absent + (F.col("leaves") - 1) * F.col("a"))).alias("phi"),
        )
    )
    valued = stars.join(of_stars, [*ANSWER, "p1", "leaves"])
    leaves = paths.select(*ANSWER, "p1", "p2", "p3").join(
        valued.select(*ANSWER, "r3", "p1", "p2", "phi"), [*ANSWER, "p1", "p2"]
    )
    return (
        of_roots.select(*ANSWER, F.col("r1").alias("relation"), F.col("p1").alias("pk"), "phi")
        .unionByName(
            valued.filter(mid).select(
                *ANSWER, F.col("r2").alias("relation"), F.col("p2").alias("pk"), F.col("center_phi").alias("phi")
            )
        )
        .unionByName(leaves.select(*ANSWER, F.col("r3").alias("relation"), F.col("p3").alias("pk"), "phi"))
    )
