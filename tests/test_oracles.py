"""Every registered query against its oracle on the smallest data."""

import pytest
from compare import connect, difference
from conftest import DATA

from pagelens.plans.catalog_of_cases import all_cases

CASES = all_cases()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "array<double>": "DOUBLE[]"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CASES.items() if sql])
def test_matches_oracle(name, tables, con):
    build, sql = CASES[name]
    df = build(tables)
    want = con.sql(sql)
    assert {c: TYPES[kind] for c, kind in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert difference(df, con, sql) is None


@pytest.mark.parametrize("name", [n for n, (_, sql) in CASES.items() if not sql])
def test_runs(name, tables):
    assert CASES[name][0](tables).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
