import os

import duckdb
import pytest
from ledgermesh.plans.linkage_queries import BUILDERS, ORACLE_SQL, QUERIES, Work

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def work(spark):
    return Work(spark, SF)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(work, con, name):
    """The builders over one shared keyed table; ``QUERIES`` wraps each with a table of its own."""
    got = BUILDERS[name](work)
    rel = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr(tuple(map(plain, r))) for r in rel.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in got.select(columns).collect()) == want


def test_every_query_is_registered(spark):
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 75
    assert QUERIES["candidates_mask"](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["missed_categories", "cascade_siblings", "features_all", "example_pairs"])
def test_queries_without_sql_run(work, name):
    assert BUILDERS[name](work).count() > 0
