"""The correctness gate: every query with SQL equals DuckDB at sf0.01;
queries without SQL run at sf0.001 (their exactness is tested elsewhere)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001, SF01
from tests.oracle_check import compare, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], SF01)
    assert r["rows"] == r["oracle_rows"], r
    assert r["cols_match"], r
    assert r["hash_match"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_query_runs(spark, name):
    df = QUERIES[name](spark, SF001)
    assert df.columns and len(df.collect()) >= 0
