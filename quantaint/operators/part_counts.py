"""Counts of tuples and parts from violating sets that are stored as keys.

What ``hitting.local_hub_gamma`` finds from nested sets, by numeric keys and in the tasks where the keys
lie: sets over lineitem and orders are written by order and are not shuffled again, others are dealt once by
their hub. A tuple has one row for all its constraints, with their numbers side by side.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaint.functions.keys import pk_text
from quantaint.operators.constraints import DenialConstraint
from quantaint.operators.scenarios import Scenario, db_ids
from quantaint.schema import DEALT, FOREIGN_KEYS, KEYS
from quantaint.sources.store import CODEC, keep


@dataclass(frozen=True)
class KeyedSets:
    """Violating sets of constraints that share a pass: (db_id, dc, the keys of their relations).

    ``dealt`` names the columns by which the rows are written; sets of one hub lie together.
    """

    rows: DataFrame
    constraints: list[DenialConstraint]
    dealt: tuple[str, ...]

    @property
    def relations(self) -> list[str]:
        return list(dict.fromkeys(r for c in self.constraints for r in c.relations))

    def of(self, relation: str) -> list[DenialConstraint]:
        return [c for c in self.constraints if relation in c.relations]


def dealt_by(constraints: list[DenialConstraint]) -> tuple[str, ...]:
    """Lines lie with their orders, and so do all sets whose hub is one of them."""
    return DEALT["lineitem"] if all(c.hub in ("lineitem", "orders") for c in constraints) else ()


def countable(passes: list[KeyedSets]) -> bool:
    """True if each pass has hubs that every tuple's key determines, and that lie together or are of one relation."""
    return all(
        all(c.hub_is_determined for c in sets.constraints)
        and (sets.dealt or len({c.hub for c in sets.constraints}) == 1)
        for sets in passes
    )


def tuple_sets(passes: list[KeyedSets], scenarios: list[Scenario], parts: int) -> dict[str, DataFrame]:
    """Per relation (place, its keys, and per constraint X sets_X, parts_X, missing_X), one row per scenario and tuple.

    ``place`` is the scenario's place in the list. A tuple is in sets_X sets, which lie in parts_X parts (one, if
    keys do not repeat), and misses some set of missing_X of them. A part is streamed by one task, never collected.
    """
    found: dict[str, list[DataFrame]] = {}
    fixed: dict[str, bool] = {}
    for sets in passes:
        deal = sets.dealt or KEYS[sets.constraints[0].hub]
        rows = _placed(sets, scenarios)
        if not sets.dealt:
            rows = keep(rows, "dealt-sets", (), deal, parts)
        for relation in sets.relations:
            counts = _counted(rows, sets.of(relation), relation, deal)
            found.setdefault(relation, []).append(counts)
            fixed[relation] = all(_fixes(relation, c.hub) for c in sets.of(relation))
    tables = {}
    for relation, counts in found.items():
        merged = counts[0] if len(counts) == 1 and fixed[relation] else _merged(counts, relation)
        tables[relation] = keep(merged, f"counts-{relation}", (), (), 0, CODEC)
    return tables


def _placed(sets: KeyedSets, scenarios: list[Scenario]) -> DataFrame:
    known = F.array_position(db_ids(scenarios), F.col("db_id")) - 1
    place = F.when(known >= 0, known).otherwise(
        F.raise_error(F.concat(F.lit("unexpected database id: "), F.col("db_id"))).cast("bigint")
    )
    keys = [key for relation in sets.relations for key in KEYS[relation]]
    return sets.rows.select(place.cast("int").alias("place"), "dc", *keys)


def _hub_columns(relation: str, hub: str) -> tuple[str, ...]:
    """The columns that tell a tuple's hub: of its own key, where that holds the hub's, so that even repeated keys have one."""
    link = KEYS[hub] if relation == hub else FOREIGN_KEYS.get((relation, hub))
    return link if link is not None and set(link) <= set(KEYS[relation]) else KEYS[hub]


def _fixes(relation: str, hub: str) -> bool:
    return set(_hub_columns(relation, hub)) <= set(KEYS[relation])


def _counted(rows: DataFrame, own: list[DenialConstraint], relation: str, deal: tuple[str, ...]) -> DataFrame:
    hubs = [key for c in own for key in _hub_columns(relation, c.hub)]
    tuples = list(dict.fromkeys(["place", *KEYS[relation], *deal, *hubs]))
    counts = (
        rows.filter(F.col("dc").isin([c.name for c in own]))
        .groupBy(*tuples)
        .agg(*[F.count_if(F.col("dc") == c.name).alias(f"sets_{c.name}") for c in own])
    )
    numbers: list[Column] = []
    for c in own:
        n = F.col(f"sets_{c.name}")
        # Each set of a part has one tuple of the relation, so these tuples' counts add up to the part's.
        part = Window.partitionBy("place", *dict.fromkeys([*deal, *_hub_columns(relation, c.hub)]))
        size = n if c.hub == relation else F.sum(n).over(part)
        numbers += [
            n,
            (n > 0).cast("int").alias(f"parts_{c.name}"),
            ((n > 0) & (n < size)).cast("int").alias(f"missing_{c.name}"),
        ]
    return counts.select("place", *KEYS[relation], *numbers)


def _merged(counts: list[DataFrame], relation: str) -> DataFrame:
    """One row per tuple, from several passes or parts."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    names = [c for c in together.columns if c not in ("place", *KEYS[relation])]
    return together.groupBy("place", *KEYS[relation]).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def counted_measures(
    tables: Mapping[str, DataFrame],
    scenarios: list[Scenario],
    constraints: list[DenialConstraint],
) -> DataFrame:
    """(db_id, relation, pk, cbm, cim, pim, rim) from ``tuple_sets``.

    gamma takes two values per group (parts - 1, parts), as in ``measures.gamma_details``.
    """
    totals = keep(_totals(tables, constraints), "part-totals")
    ids = db_ids(scenarios)
    frames = []
    for relation, table in tables.items():
        own = [c for c in constraints if relation in c.relations]

        def added(term) -> Column:
            return reduce(lambda a, b: a + b, [term(c) for c in own]).cast("double")

        def sets(c: DenialConstraint) -> Column:
            return F.col(f"sets_{c.name}")

        def rim(c: DenialConstraint) -> Column:
            hubs, missing = F.col(f"hubs_{c.name}").cast("double"), F.col(f"missing_{c.name}")
            share = (F.col(f"parts_{c.name}") - missing) * (1 / hubs) + missing * (1 / (hubs + 1))
            return F.when(sets(c) > 0, share / F.col(f"shares_{c.name}") * F.col(f"n_sets_{c.name}")).otherwise(0.0)

        scored = table.join(F.broadcast(totals), "place")
        frames.append(
            scored.select(
                F.element_at(ids, F.col("place") + 1).alias("db_id"),
                F.lit(relation).alias("relation"),
                pk_text(relation).alias("pk"),
                added(lambda c: F.col(f"parts_{c.name}")).alias("cbm"),
                added(lambda c: sets(c) * F.lit(c.relation_weights.get(relation, 0.0))).alias("cim"),
                added(lambda c: sets(c) * F.lit(c.tuple_weight)).alias("pim"),
                added(rim).alias("rim"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def _totals(tables: Mapping[str, DataFrame], constraints: list[DenialConstraint]) -> DataFrame:
    """One row per scenario: hubs, sets and the sum of 1/(1+gamma) of each constraint X as hubs_X, n_sets_X, shares_X."""
    frames = []
    for relation, table in tables.items():
        sums = []
        for c in constraints:
            if relation in c.relations:
                sums += [F.sum(f"{kind}_{c.name}").alias(f"{kind}_{c.name}") for kind in ("parts", "missing")]
                if relation == c.hub:
                    sums += [
                        F.sum(f"parts_{c.name}").alias(f"hubs_{c.name}"),
                        F.sum(f"sets_{c.name}").alias(f"n_sets_{c.name}"),
                    ]
        frames.append(table.groupBy("place").agg(*sums))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    names = [n for n in together.columns if n != "place"]
    whole = together.groupBy("place").agg(*[F.sum(n).alias(n) for n in names])
    columns = []
    for c in constraints:
        hubs, nodes, missing = (F.col(f"{kind}_{c.name}") for kind in ("hubs", "parts", "missing"))
        double = hubs.cast("double")
        # Without violations a constraint has no hubs.
        shares = F.when(hubs > 0, (nodes - missing) / double + missing / (double + 1))
        columns += [f"hubs_{c.name}", f"n_sets_{c.name}", shares.alias(f"shares_{c.name}")]
    return whole.select("place", *columns)
