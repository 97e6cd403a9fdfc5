"""The queries that SQL can express against their SQL, and the tiles of many small leaves against it too."""

import duckdb
import pytest

from feedloom.llm import embedding_dedup, queries

SMALL = "/root/testdata/sf0.01"


def both(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    return sorted(tuple(r) for r in queries.queries()[name](spark, SMALL).select(*columns).collect()), sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, name):
    got, want = both(spark, name)
    assert got == want


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "MOST_TILE", 24)
    got, want = both(spark, "op3_embedding_dedup")
    assert got == want


def test_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [-0.0, 2.0]), (8, [0.0, 2.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (None, 0, None, False)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
