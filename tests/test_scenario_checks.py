"""The checks of all scenarios against one scenario's tables at a time."""

from __future__ import annotations

from quantaint.operators import inject
from quantaint.operators.constraints import INJECTED, check_constraints
from quantaint.operators.violations import check_scenarios
from quantaint.plans import registered


def test_every_scenario_is_counted(spark, small):
    exp = registered.experiment(spark, small)
    got = {(r.db_id, r.constraint): (r.violations, r.status) for r in check_scenarios(exp.overlay).collect()}
    assert len(got) == 5 * len(registered.SCENARIOS)
    for scenario in registered.SCENARIOS:
        one = inject.narrowed(exp.overlay, [scenario])
        tables = {rel: inject.violated_relation(one, rel) for rel in INJECTED}
        (db_id,) = [r.db_id for r in tables["lineitem"].select("db_id").distinct().collect()]
        tables = {rel: df.drop("db_id") for rel, df in tables.items()}
        for r in check_constraints({**exp.database, **tables}).collect():
            assert got[db_id, r.constraint] == (r.violations, r.status)
    assert sum(n > 0 for (db_id, _), (n, _) in got.items() if "subsetA" in db_id) > 0
    names = registered.queries()
    rows = names["check_constraints_scenarios"](spark, small)
    assert rows.select("db_id").distinct().count() == len(registered.SCENARIOS)
