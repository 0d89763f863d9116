"""Shapley value of a tuple in the game "the coalition meets every support"."""

from __future__ import annotations

from collections.abc import Mapping
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaint.functions.hashing import digest_words, with_draws
from quantaint.functions.keys import tuple_id
from quantaint.operators.closed_shapley import closed_shapley, hierarchical
from quantaint.operators.supports import ANSWER, QUERIES, QuerySpec, support_size

# Exact up to this many tuples, sampled above it.
EXACT_TUPLES = 14
SAMPLES = 10_000

_TID = ["relation", "pk"]


def shapley_weights(
    supports: DataFrame,
    counts: DataFrame,
    answers_at_most: int,
    widest: int,
    exact_tuples: int = EXACT_TUPLES,
    samples: int = SAMPLES,
    specs: Mapping[str, QuerySpec] = QUERIES,
) -> DataFrame:
    """(qname, answervalue, relation, pk, phi, method) for every tuple.

    Answers of hierarchical queries have a closed form; the others are enumerated up to
    ``exact_tuples`` and sampled above.
    """
    other = ~F.col("qname").isin(hierarchical(specs))
    supports_left, counts_left = supports.filter(other), counts.filter(other)
    closed = closed_shapley(supports, specs)
    exact = exact_shapley(supports_left, counts_left, answers_at_most, exact_tuples)
    sampled = sampled_shapley(supports_left, counts_left, answers_at_most, widest, exact_tuples, samples)
    return (
        closed.withColumn("method", F.lit("closed"))
        .unionByName(exact.withColumn("method", F.lit("exact")))
        .unionByName(sampled.withColumn("method", F.lit("sampled")))
    )


def _maybe_broadcast(df: DataFrame, rows_at_most: int) -> DataFrame:
    return F.broadcast(df) if rows_at_most <= 1_000_000 else df


def exact_shapley(
    supports: DataFrame, counts: DataFrame, answers_at_most: int, exact_tuples: int = EXACT_TUPLES
) -> DataFrame:
    """Enumerate the coalitions of answers with few tuples.

    Tuples become bits, supports bit masks. A tuple is pivotal for a coalition
    that misses a support without it and meets all with it; pivotal coalitions
    of size k weigh k!(n-k-1)!/n!. Every group here has at most
    ``exact_tuples`` tuples, and one answer yields 2^n rows within its task.
    """
    small = support_size(counts).filter(F.col("support_size") <= exact_tuples)
    position = F.row_number().over(Window.partitionBy(*ANSWER).orderBy(*_TID)) - 1
    indexed = counts.join(_maybe_broadcast(small, answers_at_most), ANSWER).withColumn(
        "bit", position
    )
    layout = indexed.groupBy(*ANSWER).agg(
        F.map_from_entries(F.collect_list(F.struct(tuple_id(F.col("relation"), F.col("pk")), "bit"))).alias("bits"),
        F.count(F.lit(1)).cast("int").alias("n"),
    )
    mask = F.aggregate(
        "tuples",
        F.lit(0).cast("bigint"),
        lambda acc, t: acc.bitwiseOR(
            _bit(F.element_at("bits", tuple_id(t["relation"], t["pk"])))
        ),
    )
    masks = (
        supports.join(_maybe_broadcast(layout, answers_at_most), ANSWER)
        .select(*ANSWER, mask.alias("mask"))
        .distinct()
        .groupBy(*ANSWER)
        .agg(F.collect_list("mask").alias("masks"))
    )
    return _enumerate(masks.join(layout.select(*ANSWER, "n"), ANSWER), indexed, exact_tuples)


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def _meets_all(coalition: Column) -> Column:
    return F.forall("masks", lambda support: support.bitwiseAND(coalition) != 0)


def _enumerate(games: DataFrame, indexed: DataFrame, exact_tuples: int) -> DataFrame:
    n = F.col("n")
    every = F.sequence(F.lit(0).cast("bigint"), _bit(n) - 1)
    coalitions = games.select("*", F.explode(every).alias("c")).filter(~_meets_all(F.col("c")))
    bit = _bit(F.col("bit"))
    joins = (
        coalitions.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("bit"))
        .filter((F.col("c").bitwiseAND(bit) == 0) & _meets_all(F.col("c").bitwiseOR(bit)))
        .groupBy(*ANSWER, "bit", "n", F.bit_count("c").alias("k"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    fact = F.array(*[F.lit(float(factorial(i))) for i in range(exact_tuples + 1)])
    weight = fact[F.col("k")] * fact[n - F.col("k") - 1] / fact[n]
    phi = joins.groupBy(*ANSWER, "bit").agg(F.sum(F.col("times") * weight).alias("phi"))
    return indexed.join(phi, [*ANSWER, "bit"], "left").select(
        *ANSWER, *_TID, F.coalesce("phi", F.lit(0.0)).alias("phi")
    )


def sampled_shapley(
    supports: DataFrame,
    counts: DataFrame,
    answers_at_most: int,
    widest: int,
    exact_tuples: int = EXACT_TUPLES,
    samples: int = SAMPLES,
) -> DataFrame:
    """Estimate from random arrival orders.

    In a sample every tuple arrives at a hashed time in [0, 2^62). A support is met when its
    first tuple arrives, all supports when the last of these does; the tuple
    arriving then is pivotal. The first pass takes the earliest arrival within
    each support row and the maximum per (answer, sample), so nothing but one
    number per answer and sample is shuffled; the second pass finds the tuple
    that has the time. ``widest`` is the largest number of tuples in a support.
    """
    large = support_size(counts).filter(F.col("support_size") > exact_tuples)
    names = _maybe_broadcast(large.select(*ANSWER), answers_at_most)
    numbers = F.sequence(F.lit(1), F.lit(samples))
    words = [_digest(f"get(tuples, {i})").alias(f"t{i}") for i in range(widest)]
    arrivals = {f"u{i}": f"t{i}" for i in range(widest)}
    met = F.least(*arrivals) if widest > 1 else F.col("u0")
    sampled_supports = _spread(supports.join(names, ANSWER).select(*ANSWER, *words)).select(
        "*", F.explode(numbers).alias("sample")
    )
    completed = (
        with_draws(sampled_supports, arrivals, "sample")
        .groupBy(*ANSWER, "sample")
        .agg(F.max(met).alias("arrival"))
    )
    # One list of ``samples`` numbers per answer, laid beside the answer's tuples.
    listed = completed.groupBy(*ANSWER).agg(
        F.collect_list(F.struct("sample", "arrival")).alias("completed")
    )
    sampled_tuples = (
        _spread(
            counts.select(
                *ANSWER, *_TID, _digest("named_struct('relation', relation, 'pk', pk)").alias("t0")
            )
        )
        .join(_maybe_broadcast(listed, answers_at_most * samples), ANSWER)
        .select(*ANSWER, *_TID, "t0", F.inline("completed"))
    )
    pivots = (
        with_draws(sampled_tuples, {"u0": "t0"}, "sample")
        .filter("u0 = arrival")
        .groupBy(*ANSWER, *_TID)
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    return (
        counts.join(names, ANSWER)
        .select(*ANSWER, *_TID)
        .join(pivots, [*ANSWER, *_TID], "left")
        .select(*ANSWER, *_TID, (F.coalesce("hits", F.lit(0)) / F.lit(float(samples))).alias("phi"))
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Even out rows that each expand into thousands of samples."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def _digest(member: str) -> Column:
    """Hash words of a tuple within an answer, null for a missing tuple."""
    text = f"concat(qname, '|', answervalue, '|', {member}.relation, '#', {member}.pk)"
    return F.when(F.expr(f"{member} IS NOT NULL"), digest_words(text))
