"""Every query with SQL against that SQL, on the smallest tables; others run."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from tidemark import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == sorted(expected, key=repr)
