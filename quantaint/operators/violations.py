"""Violating sets of every scenario, per constraint."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaint.operators.constraints import (
    CONSTRAINTS,
    DC1,
    DC2,
    DC3,
    DenialConstraint,
    as_violation_sets,
    join_relations,
    passes,
    shared_pass_rows,
    with_full_keys,
)
from quantaint.operators.inject import Overlay
from quantaint.operators.part_counts import KeyedSets, dealt_by
from quantaint.operators.scenarios import db_ids
from quantaint.schema import KEYS
from quantaint.sources.store import CODEC, keep

ALL_CONSTRAINTS: tuple[str, ...] = tuple(CONSTRAINTS)


def scenario_rows(overlay: Overlay, constraints: list[DenialConstraint]) -> DataFrame:
    """Violating key combinations of every scenario's database.

    A combination either contains a changed row (found from the touched rows) or
    consists of base rows the scenario left alone (found once on the base and
    repeated per scenario, minus what the scenario changed). The base is never
    copied, and a clean base contributes nothing.
    """
    db = overlay.database
    ids = F.explode(db_ids(overlay.scenarios)).alias("db_id")
    varying = constraints[0].varying_relation
    if varying not in overlay.touched:
        return shared_pass_rows(db, constraints).select("*", ids)
    touched = overlay.touched[varying]
    changed = shared_pass_rows({**db, varying: touched}, constraints, carry=("db_id",))
    if _clean_by_itself(db[varying], constraints):
        return changed
    found = keep(shared_pass_rows(db, constraints), "base-violations")
    if found.isEmpty():
        return changed
    key = ["db_id", *KEYS[varying]]
    untouched = found.select("*", ids).join(touched.select(*key), key, "left_anti")
    return changed.unionByName(untouched)


def _clean_by_itself(rows: DataFrame, constraints: list[DenialConstraint]) -> bool:
    """True if the conditions read ``rows`` alone and none of them holds in any row, so no join is needed."""
    conditions = [F.expr(c.violated) for c in constraints]
    words = {w for c in constraints for w in re.findall(r"[a-z]+_\w+", c.violated)}
    if not words <= set(rows.columns):
        return False
    return rows.filter(reduce(lambda a, b: a | b, conditions)).isEmpty()


def violating_keys(overlay: Overlay, dcs: tuple[str, ...] = ALL_CONSTRAINTS) -> list[KeyedSets]:
    """The sets of ``violation_sets``, written as the keys of their tuples, per pass; lines by their order."""
    found = []
    for together in passes([CONSTRAINTS[dc] for dc in dcs]):
        rows = with_full_keys(scenario_rows(overlay, together), together)
        dealt = dealt_by(together)
        buckets = overlay.database.parts if dealt else 0
        found.append(KeyedSets(keep(rows, "violating-keys", (), dealt, buckets, CODEC), together, dealt))
    return found


def nested_sets(keyed: list[KeyedSets]) -> DataFrame:
    """(db_id, dc, mis_id, comp, tuples) of stored keys; names and nested tuples are built when they are read."""
    frames = [as_violation_sets(sets.rows, sets.constraints, ("db_id",)) for sets in keyed]
    return reduce(DataFrame.unionByName, frames)


def violation_sets(
    overlay: Overlay, dcs: tuple[str, ...] = ALL_CONSTRAINTS, stored: bool = False
) -> DataFrame:
    """(db_id, dc, mis_id, comp, tuples): all constraints, all scenarios.

    If ``stored``, the sets are written as their keys.
    """
    if stored:
        return nested_sets(violating_keys(overlay, dcs))
    frames = [
        as_violation_sets(scenario_rows(overlay, together), together, ("db_id",))
        for together in passes([CONSTRAINTS[dc] for dc in dcs])
    ]
    return reduce(DataFrame.unionByName, frames)


def set_counts(sets: DataFrame) -> DataFrame:
    return sets.groupBy("db_id", "dc").agg(F.count(F.lit(1)).alias("mis"))


# The stock condition of the checks, which does not ask for the part.
QUANTITY = DenialConstraint("DC5", ("lineitem", "partsupp"), "ps_availqty < 0", "partsupp", {})
_CHECKED = {
    "DC1": "DC1_receipt_before_ship",
    "DC2": "DC2_commit_before_orderdate",
    "DC3": "DC3_order_F_but_line_not_F",
    "chain": "DC4_customer_region_chain_invalid",
    "DC5": "DC5_negative_partsupp_availqty",
}


def check_scenarios(overlay: Overlay) -> DataFrame:
    """(db_id, constraint, violations, status): ``check_constraints`` of every scenario's database.

    Counted from the changed rows and once from the base, which is never copied.
    """
    ids = F.explode(db_ids(overlay.scenarios)).alias("db_id")
    chain = (
        join_relations(overlay.database, ("customer", "nation", "region"))
        .filter("r_regionkey < 0")
        .select(ids, F.lit("chain").alias("dc"))
    )
    rows = chain
    for together in ([DC1, DC2, DC3], [QUANTITY]):
        rows = rows.unionByName(scenario_rows(overlay, together).select("db_id", "dc"))
    names = F.array(*[F.struct(F.lit(dc).alias("dc"), F.lit(c).alias("constraint")) for dc, c in _CHECKED.items()])
    every = overlay.database.spark.range(1).select(ids).select("db_id", F.inline(names))
    counts = rows.groupBy("db_id", "dc").agg(F.count(F.lit(1)).alias("n"))
    found = F.coalesce("n", F.lit(0)).cast("bigint")
    return every.join(counts, ["db_id", "dc"], "left").select(
        "db_id",
        "constraint",
        found.alias("violations"),
        F.when(found == 0, "OK").otherwise("VIOLATED").alias("status"),
    )
