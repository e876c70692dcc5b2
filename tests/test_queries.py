"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import math
import os

import duckdb
import pytest

from weft.plans import queries as Q
from weft.plans import texts, tuning  # noqa: F401  (they add queries)

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DIR}/{t}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) else x
    out = [tuple(plain(r[k]) for k in order) for r in data]
    return sorted(names), sorted(out, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(Q.ORACLE_SQL[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert Q.QUERIES[name](spark, DIR).count() > 0
