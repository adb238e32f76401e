"""Every catalogue query with SQL equals DuckDB; the rest must run and return rows."""
import pytest

from innings_engine.catalog import load
from tests.compare import compare, oracle_connection

QUERIES, SQL = load()
# A match-block rank needs more calibration matches than the smallest tables hold.
LARGER = {"forecast_rows", "conformal_block", "interval_coverage", "promotion_checks"}


@pytest.fixture(scope="module")
def oracles():
    return {sf: oracle_connection(f"/root/testdata/sf{sf}") for sf in ("0.001", "0.01")}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, oracles):
    scale = "0.01" if name in LARGER else "0.001"
    df = QUERIES[name](spark, f"/root/testdata/sf{scale}")
    if name in SQL:
        ok, message = compare(df, oracles[scale], SQL[name])
        assert ok, message
    else:
        assert len(df.collect()) > 0


def test_contract():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100
