"""Queries, their answers and the minimal supports of each answer."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantaint.functions.keys import pk_text, tuple_struct
from quantaint.operators.constraints import INJECTED, join_relations
from quantaint.operators.numbering import number_rows
from quantaint.schema import KEYS, determines
from quantaint.sources.database import Database
from quantaint.sources.store import keep


@dataclass(frozen=True)
class QuerySpec:
    """A conjunctive query with one answer column.

    Each joined row is a support of its answer; ``answers_in`` lists the only
    values the answer can take, which bounds the number of answers.
    """

    name: str
    relations: tuple[str, ...]
    answer: str
    answers_in: tuple[str, ...]
    where: tuple[str, ...]
    hub: str

    @property
    def keys(self) -> list[str]:
        return [key for rel in self.relations for key in KEYS[rel]]

    @property
    def hub_is_determined(self) -> bool:
        return all(determines(rel, self.hub, self.relations) for rel in self.relations)

    @property
    def chain(self) -> tuple[str, ...] | None:
        """Relations from the root to the leaf if each one fixes the one before it, else none."""
        fixed = {r: sum(determines(r, other, self.relations) for other in self.relations) for r in self.relations}
        order = tuple(sorted(self.relations, key=fixed.__getitem__))
        linked = all(determines(b, a, self.relations) for a, b in zip(order, order[1:], strict=False))
        return order if linked else None

    @property
    def reads_injected_columns(self) -> bool:
        words = set(re.findall(r"\w+", " ".join((*self.where, self.answer))))
        return any(words & set(cols) for cols in INJECTED.values())


# The five queries.
Q1 = QuerySpec(
    "Q1",
    ("orders",),
    "o_orderpriority",
    ("1-URGENT", "2-HIGH", "3-MEDIUM"),
    (
        "o_orderdate >= DATE '1995-03-01'",
        "o_orderdate < DATE '1995-03-11'",
        "o_totalprice > 70000",
    ),
    "orders",
)
Q2 = QuerySpec(
    "Q2",
    ("orders", "lineitem"),
    "l_shipmode",
    ("AIR", "SHIP", "TRUCK", "MAIL"),
    (
        "o_orderdate >= DATE '1995-03-15'",
        "o_orderdate < DATE '1995-03-18'",
        "l_quantity > 30",
        "l_discount BETWEEN 0.04D AND 0.08D",
        "l_shipinstruct IN ('DELIVER IN PERSON', 'COLLECT COD')",
    ),
    "orders",
)
Q3 = QuerySpec(
    "Q3",
    ("customer", "orders", "nation"),
    "n_name",
    ("FRANCE", "GERMANY", "BRAZIL", "CANADA"),
    (
        "c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')",
        "o_orderdate >= DATE '1995-01-01'",
        "o_orderdate < DATE '1995-01-11'",
    ),
    "nation",
)
Q4 = QuerySpec(
    "Q4",
    ("orders", "lineitem", "supplier", "nation"),
    "n_name",
    ("FRANCE", "GERMANY", "BRAZIL"),
    (
        "o_orderdate >= DATE '1995-02-01'",
        "o_orderdate < DATE '1995-02-06'",
        "l_quantity BETWEEN 25 AND 80",
        "l_shipdate < DATE '1995-03-15'",
        "s_acctbal >= -500",
    ),
    "nation",
)
Q5 = QuerySpec(
    "Q5",
    ("orders", "lineitem", "supplier", "nation", "region"),
    "r_name",
    ("EUROPE", "ASIA", "AMERICA", "AFRICA"),
    (
        "o_orderdate >= DATE '1995-04-01'",
        "o_orderdate < DATE '1995-04-06'",
        "l_quantity > 25",
        "l_discount BETWEEN 0.02D AND 0.08D",
        "l_shipmode IN ('AIR', 'TRUCK', 'SHIP')",
    ),
    "region",
)
QUERIES: dict[str, QuerySpec] = {q.name: q for q in (Q1, Q2, Q3, Q4, Q5)}
ANSWER = ["qname", "answervalue"]


def answers_at_most(specs: Mapping[str, QuerySpec] = QUERIES) -> int:
    return sum(len(spec.answers_in) for spec in specs.values())


def support_rows(tables: Mapping[str, DataFrame], spec: QuerySpec) -> DataFrame:
    """Answer value and tuple keys of every support, one row each."""
    conditions = [F.expr(c) for c in spec.where]
    allowed = F.col(spec.answer).isin(list(spec.answers_in))
    return (
        join_relations(tables, spec.relations)
        .filter(reduce(lambda a, b: a & b, conditions, allowed))
        .select(F.col(spec.answer).cast("string").alias("answervalue"), *spec.keys)
    )


def support_sets(tables: Mapping[str, DataFrame], specs=QUERIES) -> DataFrame:
    """(qname, answervalue, comp, tuples): all supports, nested.

    Injections change columns that no query reads, so supports belong to the
    base data and are computed once for all scenarios.
    """
    frames = []
    for spec in specs.values():
        if spec.reads_injected_columns:
            raise ValueError(f"{spec.name} reads injected columns: run it per violated database")
        frames.append(
            support_rows(tables, spec).select(
                F.lit(spec.name).alias("qname"),
                "answervalue",
                pk_text(spec.hub).alias("comp"),
                F.array(*[tuple_struct(rel) for rel in spec.relations]).alias("tuples"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def answers(supports: DataFrame) -> DataFrame:
    """Distinct answers, numbered per query in order of their value.

    The distinct runs before the window; it leaves at most the answers the
    queries' value lists allow.
    """
    position = F.row_number().over(Window.partitionBy("qname").orderBy("answervalue"))
    return (
        supports.select(*ANSWER)
        .distinct()
        .select("qname", position.cast("bigint").alias("answer_id"), "answervalue")
    )


def numbered_supports(db: Database, spec: QuerySpec) -> DataFrame:
    """One row per (support, tuple) with answer and support numbers.

    The joined keys are stored once; numbers and answers both come from that table.
    """
    rows = keep(support_rows(db, spec), "support-rows")
    numbered = number_rows(rows, ["answervalue"], spec.keys, "support_id")
    listed = answers(rows.select(F.lit(spec.name).alias("qname"), "answervalue"))
    members = []
    for rel in spec.relations:
        keys = [F.col(k) for k in KEYS[rel]]
        keys += [F.lit(None).cast("bigint")] * (4 - len(keys))
        members.append(
            F.struct(
                F.lit(rel).alias("rel"),
                *[key.alias(f"key{i + 1}") for i, key in enumerate(keys)],
                pk_text(rel).alias("pk"),
            )
        )
    # At most as many answers as the query's value list.
    return numbered.join(F.broadcast(listed), "answervalue").select(
        "qname", "answer_id", "support_id", "answervalue", F.inline(F.array(*members))
    )


READING_ORDER = ["answer_id", "support_id", "rel", "key1", "key2"]


def in_reading_order(flat: DataFrame) -> DataFrame:
    """Flat supports with ``position`` = 1, 2, … within each query, in the order they are read in."""
    return number_rows(flat, ["qname"], READING_ORDER, "position")


def support_size(counts: DataFrame) -> DataFrame:
    """Distinct tuples per answer, from the per-tuple counts."""
    return counts.groupBy(*ANSWER).agg(F.count(F.lit(1)).alias("support_size"))


def nest_supports(flat: DataFrame, specs: Mapping[str, QuerySpec] = QUERIES) -> DataFrame:
    """Stored (support, tuple) rows of one scenario back to ``support_sets`` form.

    A group is a single support, one tuple per joined relation.
    """
    hub = reduce(
        lambda other, spec: F.when(F.col("qname") == spec.name, F.lit(spec.hub)).otherwise(other),
        specs.values(),
        F.lit(None).cast("string"),
    )
    member = F.struct(F.col("rel").alias("relation"), "pk")
    return (
        flat.groupBy(*ANSWER, "support_id")
        .agg(F.collect_list(member).alias("tuples"))
        .withColumn("hub", hub)
        .select(
            *ANSWER,
            F.element_at(F.filter("tuples", lambda t: t["relation"] == F.col("hub")), 1)["pk"].alias(
                "comp"
            ),
            "tuples",
        )
    )
