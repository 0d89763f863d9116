"""Result tables that a stopped run can go on with.

A run writes its rows to a folder of its own, by scenario. Only when all of them are there does it
publish one manifest row per scenario, with the number of rows that were counted while they were
written. Readers follow the manifest: rows of a run that failed are never seen, a scenario without
rows is finished like any other, and a repeated scenario is replaced by its latest run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quantaint.operators.scenarios import Scenario, literal_rows, scenario_frame
from quantaint.schema import SCENARIO_COLUMNS
from quantaint.sources.tables import by_folder

_MANIFEST = "db_id string, version int, n_rows long"


@dataclass(frozen=True)
class ResultTable:
    """Rows of many scenarios below ``path``; ``schema`` has the scenario columns."""

    spark: SparkSession
    path: str
    schema: StructType

    def manifest(self) -> DataFrame:
        """(db_id, version, n_rows) of each finished scenario's latest run; one row per scenario."""
        rows = self._read(f"{self.path}/manifest", _MANIFEST)
        return rows.groupBy("db_id").agg(
            F.max_by(F.struct("version", "n_rows"), "version").alias("last")
        ).select("db_id", "last.version", "last.n_rows")

    def pending(self, scenarios: list[Scenario], force: bool = False) -> list[Scenario]:
        """The scenarios no run has finished, in their order; ``force`` asks for all again."""
        if force:
            return scenarios
        # At most one row per scenario.
        done = {r.db_id for r in self.manifest().select("db_id").collect()}
        return [s for s, name in zip(scenarios, self._names(scenarios), strict=True) if name not in done]

    def stage(self, rows: DataFrame, scenarios: list[Scenario]) -> dict[str, int]:
        """Write ``rows``, which may hold ``scenarios`` only, as an unpublished run; its counts by scenario.

        Rows are counted as they are written, without a second pass.
        """
        version = self._next_version()
        counted = Observation()
        db_id = F.concat_ws("/", *SCENARIO_COLUMNS)
        names = self._names(scenarios)
        per_scenario = [F.count_if(db_id == name).alias(name) for name in names]
        observed = rows.observe(counted, F.count(F.lit(1)).alias("rows"), *per_scenario)
        by_folder(observed, SCENARIO_COLUMNS).write.mode("overwrite").partitionBy(*SCENARIO_COLUMNS).parquet(
            f"{self.path}/data/version={version}"
        )
        found = counted.get
        if sum(found[name] for name in names) != found["rows"]:
            raise ValueError("rows of scenarios that this run does not cover")
        return {name: found[name] for name in names}

    def publish(self, counts: Mapping[str, int]) -> None:
        """Make the last staged run visible: one manifest row per scenario, in one file."""
        version = self._next_version()
        rows = [{"db_id": name, "version": version, "n_rows": n} for name, n in counts.items()]
        listed = self.spark.range(1).select(F.inline(literal_rows(rows)))
        typed = listed.select("db_id", F.col("version").cast("int"), F.col("n_rows").cast("long"))
        typed.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def commit(self, rows: DataFrame, scenarios: list[Scenario]) -> None:
        self.publish(self.stage(rows, scenarios))

    def resume(
        self,
        scenarios: list[Scenario],
        compute: Callable[[list[Scenario]], DataFrame],
        at_once: int = 60,
        force: bool = False,
    ) -> int:
        """Compute and commit what is pending, ``at_once`` scenarios a run; the number of runs."""
        left = self.pending(scenarios, force)
        runs = [left[i : i + at_once] for i in range(0, len(left), at_once)]
        for run in runs:
            self.commit(compute(run), run)
        return len(runs)

    def read(self, scenario: Mapping[str, str] | None = None) -> DataFrame:
        """Rows of the finished scenarios; naming scenario labels reads only their folders."""
        rows = self._read(f"{self.path}/data", StructType([*self.schema.fields, StructField("version", IntegerType())]))
        for column, value in (scenario or {}).items():
            rows = rows.filter(F.col(column) == value)
        latest = self.manifest().select(
            F.col("version"), *[F.split("db_id", "/")[i].alias(c) for i, c in enumerate(SCENARIO_COLUMNS)]
        )
        # One row per scenario.
        kept = rows.join(F.broadcast(latest), ["version", *SCENARIO_COLUMNS], "left_semi")
        return kept.select(*self.schema.fieldNames())

    def _names(self, scenarios: list[Scenario]) -> list[str]:
        return [r.db_id for r in scenario_frame(self.spark, scenarios).select("db_id").collect()]

    def _read(self, path: str, schema: StructType | str) -> DataFrame:
        """The table at ``path``; no rows before the first run."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _next_version(self) -> int:
        last = self._read(f"{self.path}/manifest", _MANIFEST).agg(F.max("version")).first()[0]
        return 0 if last is None else last + 1
