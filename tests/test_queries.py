"""Every query with SQL gives the rows of its SQL in DuckDB, on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import plain_versions
from siltstone import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = registry.load()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if isinstance(v, int | str) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")
@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name].run(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(QUERIES[name].sql)
    found = [x[0] for x in cursor.description]
    assert sorted(found) == columns
    rows = cursor.fetchall()
    assert got == sorted((tuple(plain(r[found.index(c)]) for c in columns) for r in rows), key=repr)


def test_every_query_without_sql_has_a_plain_version():
    assert {n for n, q in QUERIES.items() if not q.sql} == set(plain_versions.CHECKS)


def test_balanced_quota_spends_the_remainder_on_full_names():
    from siltstone.plans.ranking import balanced

    assert balanced({"a": 10, "b": 1, "c": 10}, 5) == {"a": 3, "b": 1, "c": 1}
    assert balanced({"a": 2}, 9) == {"a": 2}
