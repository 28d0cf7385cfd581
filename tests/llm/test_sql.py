"""The contract queries that have SQL, against DuckDB on the whole tables."""

import duckdb
import pytest

from chronaxis.llm import queries
from tests.core.test_queries import SF, TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = plain(queries.queries()[name](spark, SF).toPandas()), plain(con.execute(queries.oracle_sql()[name]).df())
    assert len(got) > 0 and got == want
