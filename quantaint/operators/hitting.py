"""Minimum hitting sets of set families, without a solver.

For a tuple t of a family, gamma(t) is the size of a smallest tuple set that
meets every set not containing t. Families come as nested rows: group columns,
``comp`` (the hub tuple's key) and ``tuples``.

If every connected part has a hub (a tuple in all of its sets), a part costs one
tuple, so gamma(t) = parts - 1, plus 1 if t misses some set of its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantaint.sources.store import keep


def tuple_counts(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group, comp, relation, pk, cnt): in how many sets each tuple occurs.

    The hub's key rides in the grouping key, which keeps the aggregate hash
    based; it is determined by the tuple. Counting before the shuffle leaves one
    row per tuple and task, also for a hub of very many sets.
    """
    return (
        sets.select(*group, "comp", F.inline("tuples"))
        .groupBy(*group, "comp", "relation", "pk")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def hub_gamma(
    counts: DataFrame,
    group: list[str],
    is_hub: F.Column,
    groups_at_most: int,
    hub_is_determined: F.Column,
) -> DataFrame:
    """Add gamma, the part sizes and group totals to ``tuple_counts``.

    ``groups_at_most`` bounds the number of groups; the totals are broadcast only
    for a small bound. A group whose hub does not follow from every tuple's key
    must have a single hub, otherwise the closed form would not hold and the
    query fails; ``several_hubs`` finds such groups, which take the general method.
    """
    part = [*group, "comp"]
    parts = counts.groupBy(*part).agg(
        F.max(F.when(is_hub, F.col("cnt"))).alias("part_sets")
    )
    return _with_totals(counts.join(parts, part), group, is_hub, groups_at_most, hub_is_determined)


def local_hub_gamma(
    sets: DataFrame,
    group: list[str],
    is_hub: F.Column,
    groups_at_most: int,
    hub_is_determined: F.Column,
) -> DataFrame:
    """``hub_gamma`` of families with many small parts.

    The sets of a part are dealt to one task, where they are counted and the part is sized: one
    shuffle of the sets in place of three of their tuples. A part is streamed, never collected.
    """
    part = [*group, "comp"]
    counts = tuple_counts(sets.select(*part, "tuples").repartition(*part), group)
    hub_sets = F.max(F.when(is_hub, F.col("cnt"))).over(Window.partitionBy(*part))
    sized = keep(counts.withColumn("part_sets", hub_sets), "part-sizes")
    return _with_totals(sized, group, is_hub, groups_at_most, hub_is_determined)


def _with_totals(
    sized: DataFrame,
    group: list[str],
    is_hub: F.Column,
    groups_at_most: int,
    hub_is_determined: F.Column,
) -> DataFrame:
    joined = sized.withColumn("misses", (F.col("cnt") < F.col("part_sets")).cast("bigint"))
    n_parts = F.count_if(is_hub)
    totals = joined.groupBy(*group).agg(
        F.when(
            (n_parts > 1) & ~F.bool_and(hub_is_determined),
            F.raise_error(F.lit("several hubs in one group: use the general method")),
        )
        .otherwise(n_parts)
        .alias("parts"),
        F.sum(F.when(is_hub, F.col("cnt"))).alias("n_sets"),
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum("misses").alias("n_missing"),
    )
    if groups_at_most <= 100_000:
        totals = F.broadcast(totals)
    return joined.join(totals, group).withColumn(
        "gamma", F.col("parts") - 1 + F.col("misses")
    )


def several_hubs(
    counts: DataFrame, group: list[str], is_hub: F.Column, hub_is_determined: F.Column
) -> DataFrame:
    """Groups that have several hubs, not all of them determined by each tuple's key."""
    return (
        counts.groupBy(*group)
        .agg(F.count_if(is_hub).alias("parts"), F.bool_and(hub_is_determined).alias("determined"))
        .filter((F.col("parts") > 1) & ~F.col("determined"))
        .select(*group)
    )


def with_rho(df: DataFrame) -> DataFrame:
    return df.withColumn("rho", 1 / (1 + F.col("gamma")).cast("double"))
