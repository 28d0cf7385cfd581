"""Every query with SQL against DuckDB; every other at least runs."""

import duckdb
import pandas as pd
import pytest

from chronaxis import queries as core

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = plain(core.queries()[name](spark, SF).toPandas()), plain(duck.execute(core.oracle_sql()[name]).df())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, SF).count() > 0
