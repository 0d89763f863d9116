from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from quantaint.operators.scenarios import Scenario, scenario_frame, sweep
from quantaint.schema import SCENARIO_COLUMNS
from quantaint.sources.results import ResultTable
from quantaint.sources.tables import discover_cases, write_table

ALL = sweep("sf1", ratios=(0.001,), seeds=(1, 2, 3))


def rows_of(spark, scenarios, value, each=5):
    named = scenario_frame(spark, scenarios).select(*SCENARIO_COLUMNS)
    return named.crossJoin(spark.range(each)).select(*SCENARIO_COLUMNS, F.col("id"), F.lit(value).alias("value"))


@pytest.fixture
def results(spark, tmp_path):
    return ResultTable(spark, str(tmp_path / "scores"), rows_of(spark, ALL[:1], 0).schema)


def seen(results, **scenario):
    return sorted((r.subset, r.seed, r.value) for r in results.read(scenario).select("subset", "seed", "value").distinct().collect())


def test_nothing_stored_yet(results):
    assert results.pending(ALL) == ALL and results.read().count() == 0 and results.manifest().count() == 0


def test_failed_run_is_never_seen_and_goes_on(spark, results):
    done = []

    def compute(scenarios):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(scenarios)
        return rows_of(spark, scenarios, len(done))

    with pytest.raises(RuntimeError, match="lost"):
        results.resume(ALL, compute, at_once=2)
    assert results.pending(ALL) == ALL[4:]
    # A run that wrote its rows but was stopped before it published them.
    results.stage(rows_of(spark, ALL[4:], 99), ALL[4:])
    assert results.pending(ALL) == ALL[4:] and 99 not in {v for _, _, v in seen(results)}
    done.pop()
    assert results.resume(ALL, compute, at_once=2) == 1
    assert results.pending(ALL) == [] and results.read().count() == 5 * len(ALL)
    assert {v for _, _, v in seen(results)} == {1, 2}
    assert results.resume(ALL, compute) == 0


def test_scenarios_without_rows_are_finished(spark, results):
    results.commit(rows_of(spark, ALL[:1], 1), ALL[:3])
    assert results.pending(ALL) == ALL[3:]
    assert sorted(r.n_rows for r in results.manifest().collect()) == [0, 0, 5]


def test_repeated_scenarios_are_replaced(spark, results):
    results.commit(rows_of(spark, ALL, 1), ALL)
    results.commit(rows_of(spark, ALL[1:2], 2, each=3), ALL[1:2])
    found = seen(results)
    assert len(found) == len(ALL) and [v for s, n, v in found if (s, n) == ("subsetA", "seed02")] == [2]
    assert results.read().count() == 5 * (len(ALL) - 1) + 3
    assert results.pending(ALL, force=True) == ALL
    # A run that leaves a scenario without rows takes its old rows away.
    results.commit(rows_of(spark, ALL, 3).limit(0), ALL[:1])
    assert results.read({"subset": "subsetA", "seed": "seed01"}).count() == 0


def test_rows_of_other_scenarios_are_an_error(spark, results):
    with pytest.raises(ValueError, match="does not cover"):
        results.commit(rows_of(spark, ALL[:2], 1), ALL[:1])
    assert results.pending(ALL) == ALL


def test_one_scenario_reads_its_folder_alone(spark, results):
    results.commit(rows_of(spark, ALL, 1), ALL)
    found = results.read({"subset": "subsetB", "seed": "seed03"})
    assert {r.subset + r.seed for r in found.collect()} == {"subsetBseed03"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "seed03" in plan


def test_discovery(spark, tmp_path):
    path = str(tmp_path / "stored")
    write_table(rows_of(spark, [*ALL, Scenario("sf2", "subsetA", 0.001, 1)], 1), path)
    (tmp_path / "stored" / "scale=sf3" / "subset=subsetA" / "ratio=1pct" / "seed=seed01").mkdir(parents=True)
    other = tmp_path / "stored" / "scale=x4" / "subset=subsetA" / "ratio=1pct" / "seed=seed01"
    other.mkdir(parents=True)
    (other / "part-0.parquet").write_bytes(b"")
    found = [r.db_id for r in discover_cases(spark, path).collect()]
    assert found == sorted(found) and len(found) == len(ALL) + 1 and found[-1] == "sf2/subsetA/0p1pct/seed01"
    assert [r.db_id for r in discover_cases(spark, path, ["sf2", "sf9"]).collect()] == ["sf2/subsetA/0p1pct/seed01"]
    # A case written twice.
    rows_of(spark, ALL[:1], 2).write.mode("append").partitionBy(*SCENARIO_COLUMNS).parquet(path)
    with pytest.raises(Exception, match="several writes in case sf1/subsetA/0p1pct/seed01"):
        discover_cases(spark, path).collect()


def test_discovery_of_plain_folders(spark, tmp_path):
    place = tmp_path / "sf1" / "subsetB" / "0p1pct" / "seed10" / "mis"
    place.mkdir(parents=True)
    (place / "sets.json").write_text("{}")
    assert [tuple(r) for r in discover_cases(spark, str(tmp_path)).collect()] == [
        ("sf1", "subsetB", "0p1pct", "seed10", "sf1/subsetB/0p1pct/seed10")
    ]


def test_files_follow_the_size_of_a_folder(spark, tmp_path):
    path = str(tmp_path / "sized")
    big, small = ALL[:1], ALL[1:]
    rows = rows_of(spark, big, 1, each=400_000).withColumn("pad", F.sha2(F.col("id").cast("string"), 256))
    rows = rows.unionByName(rows_of(spark, small, 1).withColumn("pad", F.lit("")))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4m")
    try:
        write_table(rows, path)
    finally:
        spark.conf.set(key, before)
    files = {s: len(glob.glob(f"{path}/scale=sf1/subset={s[0]}/*/seed={s[1]}/*.parquet")) for s in [("subsetA", "seed01"), ("subsetB", "seed03")]}
    assert files["subsetA", "seed01"] > 3 and files["subsetB", "seed03"] == 1
