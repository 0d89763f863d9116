"""Denial constraints, their witnesses and violation counts."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaint.functions.keys import pk_text, tuple_id, tuple_struct
from quantaint.schema import FOREIGN_KEYS, KEYS, determines

# Columns an injection may change.
INJECTED: dict[str, tuple[str, ...]] = {
    "lineitem": ("l_receiptdate", "l_commitdate", "l_linestatus"),
    "partsupp": ("ps_availqty",),
}


@dataclass(frozen=True)
class DenialConstraint:
    """No combination of joined tuples may satisfy ``violated``.

    ``hub`` names the relation whose tuple all witnesses of a connected group
    share. ``relation_weights`` are the per-relation weights of a witness in the
    weighted count measure.
    """

    name: str
    relations: tuple[str, ...]
    violated: str
    hub: str
    relation_weights: Mapping[str, float]

    @property
    def tuple_weight(self) -> float:
        return 1.0 / len(self.relations)

    @property
    def varying_relation(self) -> str | None:
        """The relation whose injected columns the condition reads."""
        words = set(re.findall(r"\w+", self.violated))
        found = [rel for rel, cols in INJECTED.items() if words & set(cols)]
        if len(found) > 1:
            raise ValueError(f"{self.name} reads injected columns of {found}")
        return found[0] if found else None

    @property
    def hub_is_determined(self) -> bool:
        return all(determines(rel, self.hub, self.relations) for rel in self.relations)


# The four constraints with their weights.
DC1 = DenialConstraint(
    "DC1", ("lineitem",), "l_receiptdate < l_shipdate", "lineitem", {"lineitem": 1.0}
)
DC2 = DenialConstraint(
    "DC2",
    ("orders", "lineitem"),
    "l_commitdate < o_orderdate",
    "orders",
    {"orders": 2.0, "lineitem": 2.0},
)
DC3 = DenialConstraint(
    "DC3",
    ("orders", "lineitem"),
    "o_orderstatus = 'F' AND l_linestatus <> 'F'",
    "orders",
    {"orders": 2.0, "lineitem": 2.0},
)
DC4 = DenialConstraint(
    "DC4",
    ("lineitem", "partsupp", "part"),
    "ps_availqty < 0",
    "part",
    {"lineitem": 2.0, "partsupp": 3.0, "part": 1.0},
)
CONSTRAINTS: dict[str, DenialConstraint] = {dc.name: dc for dc in (DC1, DC2, DC3, DC4)}


def join_relations(
    tables: Mapping[str, DataFrame], relations: tuple[str, ...], how: str = "inner"
) -> DataFrame:
    """Join relations along their foreign keys, in the given order."""
    joined = tables[relations[0]]
    seen = [relations[0]]
    for relation in relations[1:]:
        links = [
            (child, parent)
            for (child, parent) in FOREIGN_KEYS
            if (child == relation and parent in seen) or (parent == relation and child in seen)
        ]
        if not links:
            raise ValueError(f"{relation} does not join to {seen}")
        equal = [
            F.col(left) == F.col(right)
            for link in links
            for left, right in zip(FOREIGN_KEYS[link], KEYS[link[1]])
        ]
        joined = joined.join(tables[relation], reduce(lambda a, b: a & b, equal), how)
        seen.append(relation)
    return joined


def witness_rows(
    tables: Mapping[str, DataFrame], constraint: DenialConstraint, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Keys of every violating combination, one row each.

    ``carry`` columns (such as the database id of a changed relation) come along.
    """
    keys = [key for rel in constraint.relations for key in KEYS[rel]]
    return (
        join_relations(tables, constraint.relations)
        .filter(F.expr(constraint.violated))
        .select(*carry, *keys)
    )


def shared_pass_rows(
    tables: Mapping[str, DataFrame],
    constraints: list[DenialConstraint],
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Violating combinations of several constraints, with their name in ``dc``.

    Constraints that read the same changed relation and otherwise only tuples
    this relation refers to need one join: references are followed by left joins,
    which keep every row once, and a constraint holds only where all its tuples
    exist.
    """
    if len(constraints) == 1:
        (only,) = constraints
        return witness_rows(tables, only, carry).withColumn("dc", F.lit(only.name))
    start = constraints[0].varying_relation
    relations = tuple(dict.fromkeys([start, *(r for c in constraints for r in c.relations)]))
    violated = [
        reduce(
            lambda a, b: a & b,
            [F.col(key).isNotNull() for rel in c.relations for key in KEYS[rel]],
            F.expr(c.violated),
        )
        for c in constraints
    ]
    names = [F.when(bad, F.lit(c.name)) for c, bad in zip(constraints, violated)]
    return (
        join_relations(tables, relations, "left")
        .filter(reduce(lambda a, b: a | b, violated))
        .select(
            *carry,
            *[key for rel in relations for key in KEYS[rel]],
            F.explode(F.array(*names)).alias("dc"),
        )
        .filter("dc IS NOT NULL")
    )


def with_full_keys(rows: DataFrame, constraints: list[DenialConstraint]) -> DataFrame:
    """``shared_pass_rows`` of which a constraint's tuple without a full key is an error."""

    def missing(relation: str) -> Column:
        used = F.col("dc").isin([c.name for c in constraints if relation in c.relations])
        return used & reduce(lambda a, b: a | b, [F.col(key).isNull() for key in KEYS[relation]])

    whole = F.lit(True)
    for relation in dict.fromkeys(r for c in constraints for r in c.relations):
        error = F.raise_error(F.lit(f"{relation}: tuple without a key")).cast("boolean")
        whole = F.when(missing(relation), error).otherwise(whole)
    # Columns stay as they are, so that rows dealt by a key are known to be.
    return rows.filter(whole)


def passes(constraints: list[DenialConstraint]) -> list[list[DenialConstraint]]:
    """Split constraints into groups that ``shared_pass_rows`` can evaluate together."""
    groups: dict[str, list[DenialConstraint]] = {}
    for c in constraints:
        start = c.varying_relation
        shareable = start is not None and all(
            determines(start, rel, (start, *c.relations)) for rel in c.relations
        )
        groups.setdefault(start if shareable else f"{c.name} alone", []).append(c)
    return list(groups.values())


def as_violation_sets(
    rows: DataFrame, constraints: list[DenialConstraint], carry: tuple[str, ...] = ()
) -> DataFrame:
    """Nested form: one row per violating set with its tuples.

    ``comp`` is the hub tuple's key; sets that share it are connected.
    """

    def per_constraint(build) -> Column:
        *others, last = constraints
        return reduce(
            lambda rest, c: F.when(F.col("dc") == c.name, build(c)).otherwise(rest),
            others,
            build(last),
        )

    def identity(c: DenialConstraint) -> Column:
        names = [tuple_id(F.lit(rel), pk_text(rel)) for rel in c.relations]
        return names[0] if len(names) == 1 else F.concat_ws("|", *names)

    return rows.select(
        *carry,
        "dc",
        per_constraint(identity).alias("mis_id"),
        per_constraint(lambda c: pk_text(c.hub)).alias("comp"),
        per_constraint(lambda c: F.array(*[tuple_struct(r) for r in c.relations])).alias("tuples"),
    )


def membership(sets: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Long form: one row per (set, tuple)."""
    return sets.select(*carry, "dc", "mis_id", F.inline("tuples"))


def check_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violation count and status of the five conditions a clean database meets.

    The three conditions over lineitem and orders share one pass: lineitem is
    kept by a left join, and a condition on a missing order is never true.
    """
    line_rows = join_relations(tables, ("lineitem", "orders"), "left")
    line_counts = line_rows.agg(
        *[
            F.count_if(F.expr(dc.violated)).cast("bigint").alias(name)
            for name, dc in (
                ("DC1_receipt_before_ship", DC1),
                ("DC2_commit_before_orderdate", DC2),
                ("DC3_order_F_but_line_not_F", DC3),
            )
        ]
    )
    chain = (
        join_relations(tables, ("customer", "nation", "region"))
        .filter("r_regionkey < 0")
        .agg(F.count(F.lit(1)).alias("DC4_customer_region_chain_invalid"))
    )
    quantity = (
        join_relations(tables, ("lineitem", "partsupp"))
        .filter("ps_availqty < 0")
        .agg(F.count(F.lit(1)).alias("DC5_negative_partsupp_availqty"))
    )
    long = [
        counts.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("constraint"), F.col(c).alias("violations"))
                        for c in counts.columns
                    ]
                )
            ).alias("r")
        ).select("r.*")
        for counts in (line_counts, chain, quantity)
    ]
    return reduce(DataFrame.unionByName, long).withColumn(
        "status", F.when(F.col("violations") == 0, "OK").otherwise("VIOLATED")
    )


def check_verdict(checked: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    return checked.groupBy(*group).agg(
        F.bool_and(F.col("violations") == 0).alias("all_ok"),
        F.count_if(F.col("violations") > 0).cast("bigint").alias("violated_constraints"),
    )
