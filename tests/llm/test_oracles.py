"""Queries that SQL expresses give DuckDB's rows."""

import duckdb
import pytest

from quillspark.llm import queries

from .conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_returns_its_rows(spark, name):
    """One row for each row of its table (two samples for each in op6)."""
    table = "pages" if name.startswith("op2") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = queries.QUERIES[name](spark, SF)
    key = "page_id" if table == "pages" else "doc_id"
    assert got.count() == n * (2 if name.startswith("op6") else 1) and got.select(key).distinct().count() == n
