"""The engine's registered queries at the smallest scale against their SQL in DuckDB."""

import os

import duckdb
import pytest

from geomotif import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert plain(df.select(*(f"`{c}`" for c in cols)).collect()) == plain(want)
