"""What a step writes and shuffles, and that the lighter plans give the same rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from quantaint.operators import components, hitting, inject, measures, violations
from quantaint.operators.scenarios import Scenario
from quantaint.plans.experiment import Experiment
from quantaint.schema import MEASURES
from quantaint.sources.testdata import clean_database

SCENARIOS = [Scenario("sft", "subsetB", 0.2, seed) for seed in (1, 2)]


def _shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


@pytest.fixture
def kept(monkeypatch):
    """(label, rows) of every table that a step writes."""
    found = []

    def record(module):
        write = module.keep

        def keep(df, label, *rest):
            table = write(df, label, *rest)
            found.append((label, table.count()))
            return table

        monkeypatch.setattr(module, "keep", keep)

    for module in (inject, components, violations):
        record(module)
    return found


def test_wide_draws_keep_each_row_once(spark, small, kept):
    db = clean_database(spark, small)
    inject.inject(db, SCENARIOS, cut_rows=500)
    rows = {n for label, n in kept if label in ("near-rows", "eligible-rows")}
    assert rows and max(rows) <= db.rows("lineitem")


def test_a_clean_base_is_not_joined_with_changes(spark, small):
    overlay = inject.inject(clean_database(spark, small), SCENARIOS)
    plan = violations.violation_sets(overlay)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_local_parts_match_joined_parts(spark):
    draws = random.Random(5)
    rows = []
    for group in ("a", "b"):
        for hub in range(6):
            for _ in range(draws.randint(1, 5)):
                rows.append((group, str(hub), [("o", str(hub)), ("l", f"{hub},{draws.randint(1, 3)}")]))
    sets = spark.createDataFrame(rows, "g string, comp string, tuples array<struct<relation: string, pk: string>>")
    hub, sure = F.col("relation") == "o", F.lit(True)
    joined = hitting.hub_gamma(hitting.tuple_counts(sets, ["g"]), ["g"], hub, 2, sure)
    local = hitting.local_hub_gamma(sets, ["g"], hub, 2, sure).select(*joined.columns)
    assert sorted(map(tuple, local.collect())) == sorted(map(tuple, joined.collect()))


def test_measures_shuffle_the_sets_once(spark, small):
    sets = Experiment(clean_database(spark, small), SCENARIOS).violations
    labels = []
    write = hitting.keep
    try:
        hitting.keep = lambda df, label, *rest: labels.append((label, _shuffles(df))) or write(df, label, *rest)
        measures.gamma_details(sets, len(SCENARIOS))
    finally:
        hitting.keep = write
    assert labels == [("part-sizes", 1)]


def test_stored_scores_are_widened_in_one_shuffle(spark):
    rows = [("s", "t", "r", "d", "lineitem", "1", m, float(i)) for i, m in enumerate(MEASURES[:3])]
    stored = spark.createDataFrame(
        rows, "scale string, subset string, ratio string, seed string, relation string, pk string, measure string, value double"
    )
    wide = measures.widen_measures(stored)
    assert _shuffles(wide) == 1
    assert [tuple(r) for r in wide.collect()] == [("s/t/r/d", "lineitem", "1", 0.0, 1.0, 2.0, 0.0)]


def test_stars_need_one_round(spark, kept):
    rows = [("g", f"{h},{i}", [("o", str(h)), ("l", f"{h},{i}")]) for h in range(3) for i in range(4)]
    sets = spark.createDataFrame(rows, "g string, mis_id string, tuples array<struct<relation: string, pk: string>>")
    parts = components.connected_parts(sets, ["g"])
    assert parts.select("root").distinct().count() == 3 and parts.count() == 15
    assert [label for label, _ in kept] == ["part-edges"] * 2


def test_chains_become_one_part(spark):
    rows = [("g", str(i), [("x", str(i)), ("x", str(i + 1))]) for i in range(40)]
    sets = spark.createDataFrame(rows, "g string, mis_id string, tuples array<struct<relation: string, pk: string>>")
    parts = components.connected_parts(sets, ["g"])
    assert parts.count() == 41 and [r.root for r in parts.select("root").distinct().collect()] == ["x#0"]


@pytest.mark.parametrize("most", [components.LOCAL_SETS, 0])
def test_hubs_of_parts_are_found_without_rounds(spark, kept, monkeypatch, most):
    """Counted per centre in one task, or before the shuffle where centres are in very many sets.

    Orders with lines, parts with supplies with lines, and sets of one tuple: no centre shares a tuple."""
    rows = []
    for h in range(3):
        for i in range(4):
            line = ("l", f"{h},{i}")
            rows.append(("a", f"a{h},{i}", [("o", str(h)), line]))
            rows.append(("b", f"b{h},{i}", [line, ("s", f"{h},{i % 2}"), ("p", str(h))]))
            rows.append(("c", f"c{h},{i}", [line]))
    rows.append((None, "m", [("l", "1,1")]))
    sets = spark.createDataFrame(rows, "g string, mis_id string, tuples array<struct<relation: string, pk: string>>")
    monkeypatch.setattr(components, "LOCAL_SETS", most)
    found = {(r.g, r.relation, r.pk): (r.cnt, r.gamma, r.n_edges, r.n_nodes) for r in components.general_gamma(sets, ["g"]).collect()}
    assert found["a", "o", "1"] == (4, 2, 8, 15) and found["a", "l", "1,2"] == (1, 3, 11, 15)
    assert found["b", "p", "1"] == (4, 2, 8, 21) and found["b", "s", "1,0"] == (2, 3, 10, 21)
    assert found["c", "l", "1,2"] == (1, 11, 11, 12) and len(found) == 15 + 21 + 12
    assert not any(n for label, n in kept if label.endswith("edges"))


def test_parts_of_several_centres(spark):
    """Random families, most of them without a hub, against enumeration."""
    draws = random.Random(11)
    families = {}
    for i in range(8):
        tuples = [(r, str(k)) for r in "xyz" for k in range(3)]
        families[f"g{i}"] = [draws.sample(tuples, draws.choice((1, 2, 3))) for _ in range(draws.randint(1, 6))]
    rows = [(g, f"m{i}", s) for g, sets in families.items() for i, s in enumerate(sets)]
    sets = spark.createDataFrame(rows, "g string, mis_id string, tuples array<struct<relation: string, pk: string>>")
    want = {(g, t): v for g, e in families.items() for t, v in brute.gamma([set(s) for s in e]).items()}
    for r in components.general_gamma(sets, ["g"]).collect():
        exact = want.pop((r.g, (r.relation, r.pk)))
        own = [s for s in families[r.g] if (r.relation, r.pk) in s]
        assert r.gamma_low <= exact <= r.gamma and (r.status != "OPTIMAL" or r.gamma == exact)
        assert (r.cnt, r.n_edges) == (len(own), len(families[r.g]) - len(own))
    assert not want
