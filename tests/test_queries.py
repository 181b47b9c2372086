"""Each registered query of the engine's own operators against its DuckDB SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from quern import queries as reference

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(f: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):  # pandas makes floats of integers beside nulls
            return repr(round(float(v), 6) + 0.0)
        return str(v)

    f = f[sorted(f.columns)]
    return sorted(tuple(map(one, r)) for r in f.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(reference.oracle_sql()))
def test_same_rows(spark, con, name):
    got = reference.queries()[name](spark, SF).toPandas()
    want = con.execute(reference.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(reference.queries()) == set(reference.oracle_sql())
