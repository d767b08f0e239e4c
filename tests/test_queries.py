"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from loomspark.plans.queries import QUERIES, SQL
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, order):
    show = lambda x: "~" if x is None else f"{float(x):.6f}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    result = con.execute(SQL[name])
    cols = [c[0] for c in result.description]
    assert sorted(cols) == sorted(df.columns)
    names = sorted(cols)
    assert plain(rows, [df.columns.index(c) for c in names]) == plain(result.fetchall(), [cols.index(c) for c in names])
