"""Tuples and parts counted by keys against those counted from nested sets."""

from __future__ import annotations

import random

import pytest

from quantaint.operators import measures, part_counts, violations
from quantaint.operators.constraints import DC1, DC2, DC3, DC4
from quantaint.operators.part_counts import KeyedSets, dealt_by
from quantaint.operators.scenarios import Scenario, scenario_frame
from quantaint.plans.experiment import Experiment
from quantaint.sources.store import keep
from quantaint.sources.testdata import clean_database

SCENARIOS = [Scenario("sft", "subsetB", 0.2, seed) for seed in (1, 2, 3)]
LINE = "db_id string, dc string, o_orderkey bigint, l_orderkey bigint, l_linenumber bigint"
SUPPLY = "db_id string, dc string, l_orderkey bigint, l_linenumber bigint, ps_partkey bigint, ps_suppkey bigint, p_partkey bigint"


def _rows(df):
    return sorted((*r[:3], *(round(v, 9) for v in r[3:])) for r in df.collect())


def _both(keyed, parts=3):
    sets = violations.nested_sets(keyed)
    chosen = {c.name: c for each in keyed for c in each.constraints}
    by_keys = measures.wide_measures(sets, SCENARIOS, chosen, keyed, parts)
    return _rows(by_keys), _rows(measures.wide_measures(sets, len(SCENARIOS), chosen))


@pytest.fixture(scope="module")
def keyed(spark):
    """Sets of few keys: repeated sets, lines in several parts, and a scenario without a constraint."""
    ids = [r.db_id for r in scenario_frame(spark, SCENARIOS).select("db_id").collect()]
    draws = random.Random(3)
    lines, supplies = [], []
    for _ in range(300):
        order, dc = draws.randint(1, 12), draws.choice(["DC1", "DC2", "DC3"])
        known = order if dc != "DC1" or order % 3 else None
        lines.append((draws.choice(ids if dc != "DC3" else ids[:2]), dc, known, order, draws.randint(1, 4)))
        part = draws.randint(1, 5)
        supplies.append((draws.choice(ids), "DC4", draws.randint(1, 12), draws.randint(1, 4), part, draws.randint(1, 3), part))
    # A line without an order has it in no constraint.
    lines = [r for r in lines if r[2] is not None or r[1] == "DC1"]
    dealt = dealt_by([DC1, DC2, DC3])
    assert dealt == ("l_orderkey",) and dealt_by([DC4]) == ()
    by_order = keep(spark.createDataFrame(lines, LINE), "test-lines", (), dealt, 3)
    return [
        KeyedSets(by_order, [DC1, DC2, DC3], dealt),
        KeyedSets(spark.createDataFrame(supplies, SUPPLY), [DC4], ()),
    ]


def test_counts_by_keys_match_nested_sets(spark, keyed):
    got, want = _both(keyed)
    assert got == want and {r[1] for r in got} == {"lineitem", "orders", "partsupp", "part"}
    for chosen in (keyed[:1], keyed[1:]):
        got, want = _both(chosen)
        assert got == want and got


def test_lines_are_sized_where_they_lie(spark, small, monkeypatch):
    """Sets over lines and orders are written by order, and lines are sized there without a shuffle."""
    exp = Experiment(clean_database(spark, small), SCENARIOS)
    (lines, _) = exp.violating_keys
    for relation in ("lineitem", "orders"):
        rows = part_counts._placed(lines, SCENARIOS)
        plan = part_counts._counted(rows, lines.of(relation), relation, lines.dealt)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(l_orderkey" not in text or exp.database.parts == 1
    written = []
    monkeypatch.setattr(part_counts, "keep", lambda df, label, *rest: written.append(label) or keep(df, label, *rest))
    wide = exp.wide_measures
    assert sorted(written) == [
        "counts-lineitem", "counts-orders", "counts-part", "counts-partsupp", "dealt-sets", "part-totals",
    ]
    assert _rows(wide) == _rows(measures.wide_measures(exp.violations, len(SCENARIOS)))


def test_scenarios_not_named_are_an_error(spark):
    rows = spark.createDataFrame([("a/b/c/d", "DC1", 1, 1, 1)], LINE)
    with pytest.raises(Exception, match="unexpected database id: a/b/c/d"):
        part_counts.tuple_sets([KeyedSets(rows, [DC1], ("l_orderkey",))], SCENARIOS, 1)
