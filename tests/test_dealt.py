"""Tables dealt by their keys, sets stored as keys, and constraints counted as bits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quantaint.operators import inject, measures, violations
from quantaint.operators.constraints import DC1, DC2, DC3, DC4, with_full_keys
from quantaint.operators.scenarios import Scenario, scenario_frame
from quantaint.plans.experiment import Experiment
from quantaint.sources.testdata import clean_database

SCENARIOS = [Scenario("sft", "subsetB", 0.2, seed) for seed in (1, 2)]
LINES = 60_000
SETS = "db_id string, dc string, tuples array<struct<relation: string, pk: string>>"


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    """Raw tables of enough lines for several buckets, with repeated keys and pairs."""
    path = str(tmp_path_factory.mktemp("delivered"))
    day = "cast(date_add(date'1995-01-01', cast(id % 900 as int)) as timestamp_ntz)"
    tables = {
        "region": (5, ["cast(id as int) r_regionkey", "concat('R', id) r_name"]),
        "nation": (25, ["cast(id as int) n_nationkey", "concat('N', id) n_name", "cast(id % 5 as int) n_regionkey"]),
        "supplier": (50, ["id s_suppkey", "concat('S', id) s_name", "cast(id % 25 as int) s_nationkey", "1.5D s_acctbal"]),
        "customer": (
            200,
            ["id c_custkey", "concat('C', id) c_name", "cast(id % 25 as int) c_nationkey", "2.5D c_acctbal", "'M' c_mktsegment"],
        ),
        "part": (
            400,
            ["id p_partkey", "concat('P', id) p_name", "'B' p_brand", "'T' p_type", "cast(id % 9 as int) p_size", "3D p_retailprice"],
        ),
        "orders": (
            LINES // 4,
            ["id o_orderkey", "id % 200 o_custkey", "substring('FOP', cast(1 + id % 3 as int), 1) o_orderstatus",
             "9D o_totalprice", f"{day} o_orderdate", "'1-URGENT' o_orderpriority"],
        ),
        "lineitem": (
            LINES,
            ["id * 7 % 15000 l_orderkey", "id % 400 l_partkey", "id % 50 l_suppkey", "cast(id % 3 as int) l_linenumber",
             "cast(id % 40 as double) l_quantity", "cast(id as double) l_extendedprice", "0.1D l_discount", "0.2D l_tax",
             "'N' l_returnflag", "'O' l_linestatus", f"{day} l_shipdate"],
        ),
    }
    for name, (rows, columns) in tables.items():
        spark.range(rows).selectExpr(*columns).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_lines_meet_their_orders_without_a_shuffle(spark, delivered, no_broadcast):
    db = clean_database(spark, delivered)
    overlay = inject.inject(db, SCENARIOS, cut_rows=5000)
    for rows in (
        violations.scenario_rows(overlay, [DC1, DC2, DC3]),
        inject.with_order(db, inject.base_rows_of(db, "lineitem"), ["DC2", "DC3"]),
    ):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_sets_are_stored_as_keys(spark, delivered, monkeypatch):
    kept = {}
    write = violations.keep

    def keep(df, label, *rest):
        kept.setdefault(label, []).append(df.dtypes)
        return write(df, label, *rest)

    monkeypatch.setattr(violations, "keep", keep)
    exp = Experiment(clean_database(spark, delivered), SCENARIOS, cut_rows=5000)
    stored, direct = exp.violations, violations.violation_sets(exp.overlay)
    assert stored.columns == direct.columns and stored.count() > LINES // 2
    assert stored.exceptAll(direct).isEmpty() and direct.exceptAll(stored).isEmpty()
    texts = {name for columns in kept["violating-keys"] for name, kind in columns if kind != "bigint"}
    assert texts == {"db_id", "dc"}


def test_stored_sets_need_full_keys(spark):
    columns = "dc string, l_orderkey bigint, l_linenumber bigint, ps_partkey bigint, ps_suppkey bigint, p_partkey bigint"
    rows = spark.createDataFrame([("DC4", 1, 2, 3, 4, 3)], columns)
    assert with_full_keys(rows, [DC4]).collect() == rows.collect()
    with pytest.raises(Exception, match="lineitem: tuple without a key"):
        with_full_keys(rows.withColumn("l_linenumber", F.lit(None).cast("bigint")), [DC4]).collect()
    # A key that the row's own constraint does not use may be missing.
    line = spark.createDataFrame([("DC1", None, 1, 2)], "dc string, o_orderkey bigint, l_orderkey bigint, l_linenumber bigint")
    assert with_full_keys(line, [DC1, DC2]).collect() == line.collect()


def test_constraints_of_many_scenarios_are_counted_as_bits(spark):
    scenarios = [Scenario("sft", "subsetB", 0.2, seed) for seed in range(1, 26)]
    ids = [r.db_id for r in scenario_frame(spark, scenarios).select("db_id").collect()]
    draws = random.Random(7)
    rows = []
    for _ in range(600):
        tuples = [(draws.choice(["orders", "lineitem"]), str(draws.randint(1, 9))) for _ in range(draws.randint(1, 3))]
        rows.append((draws.choice(ids), draws.choice(["DC1", "DC2", "DC3", "DC4", "other"]), tuples))
    rows.append((ids[-1], "other", [("part", "1")]))
    sets = spark.createDataFrame(rows, SETS)
    wide = measures.measure_cbm(sets, scenarios=scenarios)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(relation") == 1 and plan.count("Exchange") == 1
    assert wide.columns == ["db_id", "relation", "pk", "value"]
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, measures.measure_cbm(sets).collect()))


def test_sets_of_scenarios_not_named_are_an_error(spark):
    sets = spark.createDataFrame([("a/b/c/d", "DC1", [("lineitem", "1,1")])], SETS)
    with pytest.raises(Exception, match="unexpected database id: a/b/c/d"):
        measures.measure_cbm(sets, scenarios=SCENARIOS).collect()
