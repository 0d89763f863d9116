"""Experiment scenarios: which constraints are violated, how much, which seed."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaint.functions.labels import ratio_tag, seed_tag
from quantaint.schema import SCENARIO_COLUMNS

# Constraint subsets, ratios and seeds of the full experiment.
SUBSETS: dict[str, tuple[str, ...]] = {
    "subsetA": ("DC1", "DC2"),
    "subsetB": ("DC1", "DC2", "DC3", "DC4"),
}
RATIOS: tuple[float, ...] = (0.0001, 0.0005, 0.001)
SEEDS: tuple[int, ...] = tuple(range(1, 11))


@dataclass(frozen=True)
class Scenario:
    scale: str
    subset: str
    ratio: float
    seed: int

    @property
    def constraints(self) -> tuple[str, ...]:
        return SUBSETS[self.subset]


def sweep(
    scale: str,
    subsets: tuple[str, ...] = tuple(SUBSETS),
    ratios: tuple[float, ...] = RATIOS,
    seeds: tuple[int, ...] = SEEDS,
) -> list[Scenario]:
    return [Scenario(scale, *choice) for choice in product(subsets, ratios, seeds)]


def literal_rows(rows: list[dict]) -> Column:
    """An array of structs made of plain values, for ``explode`` / ``inline``."""
    return F.array(
        *[F.struct(*[F.lit(value).alias(name) for name, value in row.items()]) for row in rows]
    )


def scenario_frame(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    """One row per scenario with its labels and database id."""
    rows = literal_rows(
        [
            {
                "scale": s.scale,
                "subset": s.subset,
                "ratio_value": s.ratio,
                "seed_value": s.seed,
                "dcs": list(s.constraints),
            }
            for s in scenarios
        ]
    )
    labels = {"ratio": ratio_tag(F.col("ratio_value")), "seed": seed_tag(F.col("seed_value"))}
    return (
        spark.range(1)
        .select(F.inline(rows))
        .withColumns(labels)
        .withColumn("db_id", F.concat_ws("/", *SCENARIO_COLUMNS))
    )


def db_ids(scenarios: list[Scenario]) -> Column:
    """The scenarios' database ids as one constant array."""
    return F.array(
        *[
            F.concat_ws(
                "/",
                F.lit(s.scale),
                F.lit(s.subset),
                ratio_tag(F.lit(s.ratio)),
                seed_tag(F.lit(s.seed)),
            )
            for s in scenarios
        ]
    )


def split_db_id(df: DataFrame) -> DataFrame:
    """Scenario columns recovered from a database id; wrong shapes are an error."""
    parts = F.split("db_id", "/")
    checked = F.when(F.size(parts) == 4, parts).otherwise(
        F.raise_error(F.concat(F.lit("unexpected database id: "), F.col("db_id")))
    )
    named = [checked[i].alias(name) for i, name in enumerate(SCENARIO_COLUMNS)]
    return df.select(*named, "*")
