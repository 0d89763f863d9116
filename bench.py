"""Times the stages and headline queries; prints one JSON line.

Two workloads on the same tables: one scenario, and the full sweep of 60
scenarios (two constraint subsets, three ratios, ten seeds) in the same plans.
Every stage starts from the previous stage's table, as separate runs would.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantaint.operators import constraints, supports  # noqa: E402
from quantaint.operators.hitting import tuple_counts  # noqa: E402
from quantaint.operators.inject import injection_log  # noqa: E402
from quantaint.operators.scenarios import Scenario, sweep  # noqa: E402
from quantaint.operators.shapley import shapley_weights  # noqa: E402
from quantaint.operators.supports import ANSWER, QUERIES, answers_at_most  # noqa: E402
from quantaint.plans.experiment import Experiment  # noqa: E402
from quantaint.plans.icqa import responsibility_weights  # noqa: E402
from quantaint.sources.testdata import clean_database  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quantaint-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def clock(name: str, work) -> None:
        start = time.perf_counter()
        result = work()
        if isinstance(result, DataFrame):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    clock("load", lambda: clean_database(spark, sf_dir))
    db = clean_database(spark, sf_dir)
    clock("check_constraints", lambda: constraints.check_constraints(db))
    for spec in QUERIES.values():
        clock(f"support_{spec.name.lower()}", lambda: supports.numbered_supports(db, spec))

    scale = "sf" + os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    workloads = {"one": [Scenario(scale, "subsetB", 0.001, 1)], "sweep": sweep(scale)}
    for label, scenarios in workloads.items():
        exp = Experiment(db, scenarios)
        clock(f"{label}_inject", lambda: injection_log(exp.overlay))
        clock(f"{label}_mis_all", lambda: exp.violations)
        clock(f"{label}_tuple_measures", lambda: exp.wide_measures and exp.tuple_measures())
        if label == "one":
            clock("support_all", lambda: exp.supports)
            sets = exp.supports
            counts = tuple_counts(sets, ANSWER)
            clock("resp_weights", lambda: responsibility_weights(counts, sets))
            clock(
                "shapley_weights",
                lambda: shapley_weights(sets, counts, answers_at_most(), widest=5),
            )
        clock(f"{label}_icqa_all", lambda: exp.scores())

    print(
        json.dumps(
            {
                "metric": "total seconds of all stages",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": scale.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
