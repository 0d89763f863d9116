"""Every registered query against its SQL statement on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
import oracle
from quantaint.plans import registered

QUERIES = registered.queries()
SQL = oracle.statements()
TYPES = {
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_statement(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    types = dict(got.dtypes)
    assert {c: TYPES[types[c]] for c in columns} == dict(zip(want.columns, map(str, want.types)))
    place = [want.columns.index(c) for c in columns]
    got_rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    want_rows = sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
    assert got_rows == want_rows


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[-2:] == ["measure", "value"]
    assert df.count() > 0
