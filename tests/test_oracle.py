"""Every raster query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from gridwright import queries

TABLES = ("lineitem", "events")


@pytest.fixture(scope="module")
def con(sf001):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, con, sf001, name):
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = queries.QUERIES[name](spark, sf001)
    assert sorted(got.columns) == sorted(names)
    keys = [n for n, t in got.dtypes if t not in ("double", "float")]
    order = lambda r: tuple(str(r[k]) for k in sorted(keys)) + tuple(str(r[k]) for k in sorted(names))
    have = sorted((r.asDict() for r in got.collect()), key=order)
    want.sort(key=order)
    assert len(have) == len(want)
    bad = [(h, w) for h, w in zip(have, want, strict=True) if not all(same(h[n], w[n]) for n in names)]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_gives_rows(spark, sf001, name):
    assert queries.QUERIES[name](spark, sf001).count() > 0
