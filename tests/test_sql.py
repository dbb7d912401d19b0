"""Every registered query against its SQL on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle.check import connect, difference

from .conftest import SMALL

SQL = oracle_sql()
PLANS = queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_sql_has_a_plan():
    assert set(SQL) <= set(PLANS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_answer(spark, duck, name):
    got = PLANS[name](spark, SMALL).toArrow()
    want = duck.execute(SQL[name]).to_arrow_table()
    assert difference(got, want) is None
    assert got.num_rows > 0


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert PLANS[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["source", "n_lines", "n_removed"]
