"""Every corpus query equals its SQL on a whole small table, or returns rows of its contract."""
import pytest

from innings_engine.llm.queries import QUERIES, SQL
from tests.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    ok, message = compare(QUERIES[name](spark, SF), oracle_connection(SF), SQL[name])
    assert ok, message


#: Source and rows per source row of the queries that aren't one row per document.
SHAPE = {"op4_warc_derivatives": ("pages", 2), "op11_embedding_whitening": ("embeddings", 32)}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_has_its_rows_per_source_row(spark, name):
    source, times = SHAPE.get(name, ("documents", 1))
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert QUERIES[name](spark, SF).count() == n * times
