"""Every registered query of the engine against its oracle SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from gristmill.plans import catalog

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows or name in ("placeholder_filter",)
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_every_oracle_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(catalog.queries()) <= set(entry.queries())
