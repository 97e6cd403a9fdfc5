"""The stored index against a search of all vectors."""

import numpy as np
import pytest

from feedloom.operators import vector_index

V = "record_id long, embedding array<double>"


def rows(seed=3, n=600, dims=16, centres=12):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dims))
    return [(k, (at[k % centres] + rng.normal(size=dims) * 0.4).tolist()) for k in range(n)]


def plain(stock, asked, most):
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    out = []
    for q, v in asked:
        near = sorted((-round(float(unit(v) @ unit(x)), 9), i) for i, x in stock)[:most]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(near)]
    return sorted(out)


def searched(spark, asked, path, **how):
    df = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    return sorted((r["query_id"], r["record_id"], r["similarity"], r["place"]) for r in vector_index.search(df, path, **how).collect())


def close(got, want):
    return [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(got, want))


def test_exact_search_after_additions(spark, tmp_path, monkeypatch):
    """Vectors are added in two more steps, one of them twice; copies tie and go by their ids."""
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    stock, path = rows() + [(1_000 + n, rows()[0][1]) for n in range(30)], str(tmp_path / "index")
    frame = lambda some: spark.createDataFrame(some, V)
    vector_index.build(frame(stock[:300]), path)
    centres = spark.read.parquet(f"{path}/centres").collect()
    for part in (stock[300:], stock[300:], [(5, stock[9][1])]):
        vector_index.add(frame(part), path)
    assert spark.read.parquet(f"{path}/centres").collect() == centres and spark.read.parquet(f"{path}/vectors").count() == len(stock)
    asked = [s for s in stock if s[0] % 50 == 0]
    assert close(searched(spark, asked, path, most=40, exact=True, probes=1), plain(stock, asked, 40))
    got, want = searched(spark, asked, path, most=10, probes=6), plain(stock, asked, 10)
    assert len({x[:2] for x in got} & {x[:2] for x in want}) >= 0.9 * len(want)


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Probing the default share of the cells finds 0.9 of the 40 nearest that an exact search finds."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as record_id", "embedding")
    path = str(tmp_path / "index")
    vector_index.build(given, path)
    asked = given.where("record_id % 50 = 0").withColumnRenamed("record_id", "query_id")
    pairs = lambda **how: {(r["query_id"], r["record_id"]) for r in vector_index.search(asked, path, **how).collect()}
    want = pairs(exact=True)
    assert len(want) == 40 * asked.count() and len(pairs() & want) >= 0.9 * len(want)


def test_only_probed_cells_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    vector_index.build(spark.createDataFrame(rows(), V), path)
    index = spark.read.parquet(f"{path}/vectors")
    cells = index.select("cell").distinct().count()
    one = vector_index.search(spark.createDataFrame(rows()[:1], "query_id long, embedding array<double>"), path, most=3, probes=1)
    assert cells > 5 and one.count() == 3
    assert "PartitionFilters: [isnotnull(cell" in index.where("cell in (1)")._jdf.queryExecution().toString()


def test_odd_rows(spark, tmp_path):
    odd = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [0.0, 2.0]), (5, [0.0, 3.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0])]
    path = str(tmp_path / "index")
    vector_index.build(spark.createDataFrame(odd, V), path)
    asked = [(1, [2.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (None, [1.0, 0.0])]
    assert searched(spark, asked, path, exact=True) == [(1, 1, 1.0, 1), (1, 5, 0.0, 2)]
    with pytest.raises(Exception, match="length 2"):
        vector_index.add(spark.createDataFrame([(9, [1.0, 2.0, 3.0])], V), path)


def test_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    vector_index.build(spark.createDataFrame([], V), path)
    assert searched(spark, [(1, [1.0])], path) == []
