"""Every query against its SQL in DuckDB, and every other one for its rows."""

import math

import duckdb
import pytest

from feedloom.plans.catalogue import flagship, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_its_sql(spark, duck, name):
    got = queries()[name](spark, SMALL)
    want = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    want_rows, got_rows = canon(columns, want.fetchall()), canon(got.columns, [tuple(r) for r in got.collect()])
    assert len(got_rows) == len(want_rows)
    assert [x for x in zip(got_rows, want_rows) if x[0] != x[1]][:3] == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0 or name == "tx06_redactions"


def test_flagship(spark):
    assert flagship(spark, SMALL).count() > 0
