"""Every registered plan against its DuckDB twin on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from oracle_harness import compare, duck

from conftest import SF_SMALL

SQL = entry.oracle_sql()
PLANS = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_matches_oracle(spark, con, name):
    problems, _ = compare(spark, con, name, PLANS[name], SQL[name], SF_SMALL)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_plan_without_oracle_runs(spark, name):
    df = PLANS[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_every_oracle_has_a_plan():
    assert set(SQL) <= set(PLANS)


def test_entry_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["lang"] for r in rows} <= {"en", "fr", "de", "es"}
    assert all(0 <= r["accuracy_percent"] <= 100 for r in rows)
