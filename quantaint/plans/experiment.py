"""The stages in order, each kept once so later stages start from a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from quantaint.operators.inject import CUT_ROWS, Overlay, inject
from quantaint.operators.measures import long_measures, wide_measures
from quantaint.operators.part_counts import KeyedSets
from quantaint.operators.scenarios import Scenario
from quantaint.operators.shapley import SAMPLES
from quantaint.operators.supports import support_sets
from quantaint.operators.violations import ALL_CONSTRAINTS, nested_sets, violating_keys
from quantaint.plans.icqa import answer_scores, answer_weights
from quantaint.schema import MEASURES
from quantaint.sources.database import Database
from quantaint.sources.store import keep
from quantaint.sources.tables import by_folder


@dataclass(frozen=True)
class Experiment:
    """A database and the scenarios to run on it."""

    database: Database
    scenarios: list[Scenario]
    dcs: tuple[str, ...] = ALL_CONSTRAINTS
    cut_rows: int = CUT_ROWS
    samples: int = SAMPLES

    @cached_property
    def overlay(self) -> Overlay:
        return inject(self.database, self.scenarios, self.cut_rows)

    @cached_property
    def violating_keys(self) -> list[KeyedSets]:
        return violating_keys(self.overlay, self.dcs)

    @cached_property
    def violations(self) -> DataFrame:
        return nested_sets(self.violating_keys)

    @cached_property
    def supports(self) -> DataFrame:
        return keep(support_sets(self.database), "support-sets")

    @cached_property
    def wide_measures(self) -> DataFrame:
        keyed, parts = self.violating_keys, self.database.parts
        return keep(wide_measures(self.violations, self.scenarios, keyed=keyed, parts=parts), "measures")

    @cached_property
    def weights(self) -> DataFrame:
        return keep(answer_weights(self.supports, samples=self.samples), "weights")

    def tuple_measures(self, measures: tuple[str, ...] = MEASURES) -> DataFrame:
        return long_measures(self.wide_measures, measures)

    def gathered_measures(self, measures: tuple[str, ...] = MEASURES) -> DataFrame:
        """``tuple_measures`` by scenario, for writing: tuples are shuffled before they become a row per score."""
        return long_measures(by_folder(self.wide_measures, ["db_id"]), measures)

    def scores(self, rows: str = "all") -> DataFrame:
        return answer_scores(
            self.supports, self.wide_measures, self.scenarios, rows=rows, weights=self.weights
        )
