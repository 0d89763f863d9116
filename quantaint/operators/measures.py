"""The four inconsistency measures of a tuple."""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaint.operators.components import general_gamma
from quantaint.operators.constraints import CONSTRAINTS, DenialConstraint
from quantaint.operators.hitting import hub_gamma, local_hub_gamma, several_hubs, tuple_counts
from quantaint.operators.part_counts import KeyedSets, countable, counted_measures, tuple_sets
from quantaint.operators.scenarios import Scenario, db_ids, split_db_id
from quantaint.schema import MEASURES, SCENARIO_COLUMNS
from quantaint.sources.store import keep

_TUPLE = ["db_id", "relation", "pk"]
# Bits used of a bigint.
WORD_BITS = 60


def _relation_weight(constraints: Mapping[str, DenialConstraint]) -> Column:
    """Weight of one occurrence by (dc, relation); unknown pairs weigh nothing."""
    weight = F.lit(0.0)
    for dc in constraints.values():
        for relation, value in dc.relation_weights.items():
            here = (F.col("dc") == dc.name) & (F.col("relation") == relation)
            weight = F.when(here, F.lit(value)).otherwise(weight)
    return weight


def _tuple_weight(constraints: Mapping[str, DenialConstraint]) -> Column:
    weight = F.lit(0.0)
    for dc in constraints.values():
        weight = F.when(F.col("dc") == dc.name, F.lit(dc.tuple_weight)).otherwise(weight)
    return weight


def _members(sets: DataFrame) -> DataFrame:
    return sets.select("db_id", "dc", F.inline("tuples"))


def measure_cbm(
    sets: DataFrame, constraints=CONSTRAINTS, scenarios: list[Scenario] | None = None
) -> DataFrame:
    """Number of constraints that involve the tuple.

    If the sets' scenarios are named, a tuple is shuffled once for all of them, with a bit per
    scenario and constraint.
    """
    if scenarios is None:
        touched = sum(
            (F.max((F.col("dc") == name).cast("double")) for name in constraints), F.lit(0.0)
        )
        return _members(sets).groupBy(*_TUPLE).agg(touched.alias("value"))
    # A scenario has a bit that says that the tuple occurs in it, and one per constraint.
    ids, names = db_ids(scenarios), F.array(*[F.lit(name) for name in constraints])
    width = 1 + len(constraints)
    per_word = WORD_BITS // width
    words = range(ceil(len(scenarios) / per_word))
    bits = F.lit(1).cast("bigint").bitwiseOR(
        F.when(F.array_contains(names, F.col("dc")), _bit(F.array_position(names, F.col("dc")))).otherwise(0)
    )
    known = F.array_position(ids, F.col("db_id")) - 1
    place = F.when(known >= 0, known).otherwise(
        F.raise_error(F.concat(F.lit("unexpected database id: "), F.col("db_id"))).cast("bigint")
    )
    marked = sets.select(
        place.alias("place"), bits.alias("bits"), "tuples"
    ).select(
        F.expr(f"cast(place div {per_word} as int)").alias("word"),
        F.call_function("shiftleft", F.col("bits"), (F.col("place") % per_word * width).cast("int")).alias("mask"),
        F.inline("tuples"),
    )
    masks = [F.bit_or(F.when(F.col("word") == w, F.col("mask"))).alias(f"word{w}") for w in words]
    tuples = marked.groupBy("relation", "pk").agg(*masks)
    own = [
        F.shiftright(F.col(f"word{i // per_word}"), i % per_word * width).bitwiseAND((1 << width) - 1)
        for i in range(len(scenarios))
    ]
    scores = [
        F.when(bits.bitwiseAND(1) == 1, F.struct(ids[i].alias("db_id"), (F.bit_count(bits) - 1).cast("double").alias("value")))
        for i, bits in enumerate(own)
    ]
    found = tuples.select("relation", "pk", F.inline(F.array_compact(F.array(*scores))))
    return found.select(*_TUPLE, "value")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def measure_cim(sets: DataFrame, constraints=CONSTRAINTS) -> DataFrame:
    """Violating sets of the tuple, weighted by constraint and relation."""
    scored = _members(sets).withColumn("w", _relation_weight(constraints)).filter("w <> 0")
    return scored.groupBy(*_TUPLE).agg(F.sum("w").alias("value"))


def measure_pim(sets: DataFrame, constraints=CONSTRAINTS) -> DataFrame:
    """Violating sets of the tuple, each shared equally by its members."""
    scored = _members(sets).withColumn("w", _tuple_weight(constraints)).filter("w <> 0")
    return scored.groupBy(*_TUPLE).agg(F.sum("w").alias("value"))


def measure_rim(sets: DataFrame, scenarios: int, constraints=CONSTRAINTS) -> DataFrame:
    """The tuple's share of the violating sets by hitting-set responsibility."""
    return (
        rim_by_constraint(gamma_details(sets, scenarios, constraints))
        .groupBy(*_TUPLE)
        .agg(F.sum("rim").alias("value"))
    )


def gamma_details(sets: DataFrame, scenarios: int, constraints=CONSTRAINTS) -> DataFrame:
    """Per (db_id, dc, tuple): gamma, its lower bound and status, remaining sets, number of tuples.

    ``shares`` is the sum of 1/(1+gamma) over the tuples of the group. Where constraints have a hub
    that not every tuple's key determines, groups with several hubs take the general method.
    """
    is_hub = F.lit(False)
    determined = F.lit(False)
    for dc in constraints.values():
        here = F.col("dc") == dc.name
        is_hub = is_hub | (here & (F.col("relation") == dc.hub))
        determined = determined | (here & F.lit(dc.hub_is_determined))
    group, most = ["db_id", "dc"], scenarios * len(constraints)
    if all(dc.hub_is_determined for dc in constraints.values()):
        return _closed_gamma(local_hub_gamma(sets, group, is_hub, most, determined))
    counts = keep(tuple_counts(sets, group), "set-counts")
    odd = keep(several_hubs(counts, group, is_hub, determined), "several-hubs")
    plain = counts.join(F.broadcast(odd), group, "left_anti")
    closed = _closed_gamma(hub_gamma(plain, group, is_hub, most, determined))
    if odd.isEmpty():
        return closed
    general = keep(general_gamma(sets.join(F.broadcast(odd), group, "left_semi"), group), "general-gamma")
    shares = general.groupBy(*group).agg(F.sum(1 / (1 + F.col("gamma")).cast("double")).alias("shares"))
    open_parts = general.withColumn("n_sets", F.col("n_edges") + F.col("cnt")).join(F.broadcast(shares), group)
    return closed.unionByName(open_parts.select(*closed.columns))


def _closed_gamma(gamma: DataFrame) -> DataFrame:
    """The columns of ``gamma_details`` from the closed form.

    gamma takes two values per group (parts - 1, parts), so the sum of shares is
    exact from counts and needs no second pass over the tuples.
    """
    parts = F.col("parts").cast("double")
    present = F.col("n_nodes") - F.col("n_missing")
    return gamma.select(
        "db_id", "dc", "relation", "pk", "cnt", "gamma", "n_sets", "n_nodes",
        (F.col("n_sets") - F.col("cnt")).alias("n_edges"),
        F.col("gamma").alias("gamma_low"),
        F.lit("OPTIMAL").alias("status"),
        (present / parts + F.col("n_missing") / (parts + 1)).alias("shares"),
    )


def rim_by_constraint(gamma: DataFrame) -> DataFrame:
    """Spread a constraint's set count over its tuples in proportion to 1/(1+gamma)."""
    share = 1 / (1 + F.col("gamma")).cast("double") / F.col("shares")
    return gamma.withColumn("rim", share * F.col("n_sets"))


def wide_measures(
    sets: DataFrame,
    scenarios: int | list[Scenario],
    constraints=CONSTRAINTS,
    keyed: list[KeyedSets] | None = None,
    parts: int = 0,
) -> DataFrame:
    """One row per tuple and scenario with all four measures.

    If the same sets are given as ``keyed`` ones of named scenarios, tuples are counted by their keys, dealt
    to ``parts`` tasks.
    """
    if keyed and countable(keyed):
        tables = tuple_sets(keyed, scenarios, parts)
        return counted_measures(tables, scenarios, [c for each in keyed for c in each.constraints])
    most = scenarios if isinstance(scenarios, int) else len(scenarios)
    per_constraint = rim_by_constraint(gamma_details(sets, most, constraints))
    return per_constraint.groupBy(*_TUPLE).agg(
        F.count(F.lit(1)).cast("double").alias("cbm"),
        F.sum(F.col("cnt") * _relation_weight(constraints)).alias("cim"),
        F.sum(F.col("cnt") * _tuple_weight(constraints)).alias("pim"),
        F.sum("rim").alias("rim"),
    )


def long_measures(wide: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """One row per tuple, scenario and measure, with the scenario's labels."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(m.lower()).alias("value"))
            for m in measures
        ]
    )
    # Labels are cut from the id once per tuple, before its scores become rows.
    return split_db_id(wide.select(*_TUPLE, pairs.alias("pairs"))).select(
        *SCENARIO_COLUMNS, *_TUPLE, F.inline("pairs")
    )


def measure_counts(long: DataFrame) -> DataFrame:
    """Tuples with a score, per scenario and measure."""
    return long.groupBy("db_id", "measure").agg(F.count(F.lit(1)).alias("nonzero"))


def normalise_measures(stored: DataFrame) -> DataFrame:
    """Stored scores with every label as text and upper-case measure names."""
    needed = [*SCENARIO_COLUMNS, "relation", "pk", "measure"]
    missing = [c for c in [*needed, "value"] if c not in stored.columns]
    if missing:
        raise ValueError(f"missing columns in measures: {missing}")
    text = [F.col(c).cast("string").alias(c) for c in needed[:-1]]
    return stored.select(*text, F.upper(F.col("measure").cast("string")).alias("measure"), "value")


def widen_measures(stored: DataFrame) -> DataFrame:
    """Normalised stored scores back to one row per tuple and scenario."""
    # One aggregate of all measures: a pivot would shuffle every score twice.
    names = [
        F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("value"))), F.lit(0.0)).alias(m.lower())
        for m in MEASURES
    ]
    tuples = stored.groupBy(F.concat_ws("/", *SCENARIO_COLUMNS).alias("db_id"), "relation", "pk")
    return tuples.agg(*names).select(*_TUPLE, *[m.lower() for m in MEASURES])
