"""Every query of the library runs on the smallest tables, and equals its SQL there."""

import os

import duckdb
import pytest

from lineagram.plans import catalog, extended  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in ("events", "documents", "pages", "lineitem", "orders", "customer"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([tuple(str(show(r[i])) for i in order) for r in values])


@pytest.mark.parametrize("name", list(catalog.CATALOG))
def test_query(spark, con, name):
    got = catalog.CATALOG[name](spark, SF)
    values = [tuple(r) for r in got.collect()]
    if name in catalog.SQL:
        want = con.execute(catalog.SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, values) == rows(columns, want.fetchall())
