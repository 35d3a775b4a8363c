"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def value(x):
    return "~" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def names():
    from folio_spark.plans import registry

    return sorted(registry.queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, tables, name):
    from folio_spark.plans import registry

    df = registry.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    got = sorted(tuple(map(value, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    result = tables.execute(sql)
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    assert got == sorted(tuple(value(r[i]) for i in order) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
