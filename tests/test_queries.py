"""Every registered query of the graph engine against its SQL, at the smallest size."""

from __future__ import annotations

import os

import pytest

from skein.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(x):
    return repr(x + 0.0) if isinstance(x, float) else str(list(x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got = catalog.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in got.collect())
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_whole_tables_reach_the_operators(spark):
    rows = lambda name: catalog.queries()[name](spark, DATA)
    count = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").count()
    closed = rows("containment_closure_whole")
    assert closed.where("depth = 0").count() == sum(map(count, ("region", "nation", "customer", "supplier"))) and closed.where("id like 's%' and depth = 2").count()
    assert rows("drawn_edges_whole").count() == min(24_000, count("lineitem")) > 1000
    assert {r.status for r in rows("resolve_lexical_whole").select("status").distinct().collect()} == {"resolved", "unresolved", "unbound"}
    assert all(rows(f"{n}_whole").count() for n in ("dangling_edges", "parent_cycles", "duplicate_ids", "resolve_unique"))
