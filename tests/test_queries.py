"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from seqloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark pages conversations labels".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = db.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in rows.description]
    want = rows.fetchall()
    assert sorted(got.columns) == sorted(names)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    assert a == sorted((tuple(map(plain, r)) for r in want), key=repr) and a


def test_queries_without_sql_run(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, SF).count() > 0
