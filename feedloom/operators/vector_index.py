"""A stored index of vectors: an inverted file of cells, searched by probes or exactly.

``build`` finds centres and writes the vectors, as unit vectors, as Parquet partitioned by the cell of the nearest centre. ``add`` puts
new vectors into the cells there are. A search reads only the cells that it probes. No vector of a cell is nearer to
a query than its centre is, less the cell's radius; so an exact search goes on to the cells whose radius lets them still win,
from the most promising on, until there is none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.operators.cells import apart, centres, usable
from feedloom.storage import stored

#: Queries that are searched for together, at most; the share of the cells that a search without ``exact`` probes, unless told how many.
#: Vectors without clusters need so many for a recall of 0.9; vectors with clusters need far fewer.
QUERIES, SHARE = 4_096, 0.7
#: Cells that an exact search asks first.
PROBES = 16
#: Likeness counts to so many decimals; bounds are widened by that.
DECIMALS = 9
FOUND = "query_id long, record_id long, similarity double"


def _unit(vectors: DataFrame, key: str) -> DataFrame:
    fit = vectors.where(F.col(key).isNotNull() & usable(F.col("embedding")))
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return fit.select(F.col(key), F.transform(v, lambda x: x / norm).alias("v"))


def build(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Makes the index of ``vectors`` (record_id, embedding: of one length) in the folder ``path``. Vectors that are null, zero or hold a null or no number, and null ids, are left out."""
    found = centres(_unit(vectors, "record_id"), "record_id", cells)
    rows = [(n, x.tolist()) for n, x in enumerate(found)]
    vectors.sparkSession.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    add(vectors, path)


def add(vectors: DataFrame, path: str) -> None:
    """Adds those of ``vectors`` whose record_id isn't in the index yet, so doing it again after a failure adds nothing twice. Of rows of one record_id one is added; vectors of another length are refused."""
    spark = vectors.sparkSession
    at, dim = _centres(spark, path), None
    new = _unit(vectors, "record_id").dropDuplicates(["record_id"])
    if _written(spark, path):
        new = new.join(spark.read.parquet(f"{path}/vectors").select("record_id"), "record_id", "left_anti")
    if not len(at):
        return
    dim = at.shape[1]
    shared = spark.sparkContext.broadcast(at)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if (batch["v"].str.len() != dim).any():
                raise ValueError(f"the index holds vectors of length {dim}")
            away = apart(np.stack(batch["v"]), shared.value) if len(batch) else np.empty((0, 1))
            cell = away.argmin(1) if len(batch) else []
            yield batch.assign(away=away[np.arange(len(batch)), cell], cell=cell)

    dealt = stored(new.mapInPandas(assign, "record_id long, v array<double>, away double, cell int"))
    # bounds first: without the vectors they are only looser
    dealt.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{path}/bounds")
    # a task has few cells, a large cell several tasks
    dealt.repartitionByRange("cell", "record_id").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def _written(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/vectors")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows], np.float64)


def _best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "record_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


class _Block:
    """A bounded number of queries, with the cells in the order in which each goes to them."""

    def __init__(self, rows: list, at: np.ndarray, radius: np.ndarray):
        self.ids = np.array([r["query_id"] for r in rows], np.int64)
        self.x = np.array([r["v"] for r in rows], np.float64)
        away = apart(self.x, at)
        near = np.maximum(0, away - radius)
        self.bound = np.where(radius >= 0, 1 - near**2 / 2, -9)  # a negative radius: an empty cell
        # first the nearest centres
        self.order = np.argsort(np.where(radius >= 0, away, 9), axis=1, kind="stable")
        self.asked = np.zeros_like(self.bound, bool)

    def nearest(self, n: int) -> np.ndarray:
        """The first n cells of each query."""
        wave = np.zeros_like(self.asked)
        np.put_along_axis(wave, self.order[:, :n], True, axis=1)
        return wave & (self.bound > -9)

    def winnable(self, last: np.ndarray, n: int) -> np.ndarray:
        """Of the cells not yet asked those that can still win against each query's last, the n of highest bounds."""
        able = ~self.asked & (self.bound > -9) & (self.bound >= last[:, None] - 10.0**-DECIMALS)
        wave = np.zeros_like(self.asked)
        np.put_along_axis(wave, np.argsort(np.where(able, -self.bound, 9), axis=1, kind="stable")[:, :n], True, axis=1)
        return wave & able


def _probed(index: DataFrame, block: _Block, wave: np.ndarray, last: np.ndarray, most: int) -> DataFrame:
    """What the queries find in the cells of the wave; other cells aren't read."""
    block_ids, x = block.ids, block.x
    shared = index.sparkSession.sparkContext.broadcast((block_ids, x, {int(c): np.flatnonzero(wave[:, c]) for c in np.flatnonzero(wave.any(0))}, last))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, asked, least = shared.value
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                own = asked[cell]
                names, v = part["record_id"].to_numpy(), np.stack(part["v"])
                for a in range(0, len(own), 1_024):
                    who = own[a : a + 1_024]
                    like = np.round(q[who] @ v.T, DECIMALS)
                    i, j = np.nonzero(like >= least[who][:, None])
                    order = np.lexsort((names[j], -like[i, j], i))
                    i, j = i[order], j[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < most
                    yield pd.DataFrame({"query_id": ids[who[i[keep]]], "record_id": names[j[keep]], "similarity": like[i, j][keep]})

    cells = [int(c) for c in np.flatnonzero(wave.any(0))]
    return index.where(F.col("cell").isin(cells)).select("record_id", "v", "cell").mapInPandas(search, FOUND)


def search(queries: DataFrame, path: str, most: int = 40, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, record_id, similarity, place): the ``most`` indexed vectors of largest cosine, to nine decimals, for each of ``queries`` (query_id, embedding); the smaller record_id of equals.

    Without ``exact`` only the ``probes`` cells of the nearest centres are searched. Queries whose vector is null, zero, of
    another length, or holds a null or no number have no rows; of rows of one query_id one counts. Queries go by blocks of neighbours, so that a block reads few cells.
    """
    spark = queries.sparkSession
    at = _centres(spark, path)
    nothing = spark.createDataFrame([], f"{FOUND}, place int")
    if not len(at) or not _written(spark, path):
        return nothing
    probes = probes or (PROBES if exact else math.ceil(SHARE * len(at)))
    radius = np.full(len(at), -1.0)
    for r in spark.read.parquet(f"{path}/bounds").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radius[r["cell"]] = r["radius"]
    shared, dim = spark.sparkContext.broadcast(at), at.shape[1]

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=apart(np.stack(batch["v"]), shared.value).argmin(1))

    asked = _unit(queries, "query_id").where(F.size("v") == dim).dropDuplicates(["query_id"])
    asked = stored(asked.mapInPandas(home, "query_id long, v array<double>, cell int"))
    index = spark.read.parquet(f"{path}/vectors")
    parts = [_block_search(index, _Block(asked.where(chosen).collect(), at, radius), most, probes, exact) for chosen in _chosen(asked)]
    return reduce(DataFrame.unionByName, parts) if parts else nothing


def _chosen(asked: DataFrame) -> Iterator:
    """Conditions that cut the queries into blocks: those of neighbouring cells together, those of a cell with many apart by a hash."""
    cells: list[int] = []
    held = 0
    for r in asked.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect():
        if r["n"] > QUERIES:
            pieces = -(-2 * r["n"] // QUERIES)
            for k in range(pieces):
                yield (F.col("cell") == r["cell"]) & (F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == k)
            continue
        if held + r["n"] > QUERIES:
            yield F.col("cell").isin(cells)
            cells, held = [], 0
        cells.append(r["cell"])
        held += r["n"]
    if cells:
        yield F.col("cell").isin(cells)


def _block_search(index: DataFrame, block: _Block, most: int, probes: int, exact: bool) -> DataFrame:
    last = np.full(len(block.ids), -9.0)
    place = {int(q): n for n, q in enumerate(block.ids)}
    wave, best, step = block.nearest(probes), None, probes
    while wave.any():
        found = _probed(index, block, wave, last, most)
        if best is not None:
            found = found.unionByName(best.drop("place"))
        best = stored(_best(found, most))
        block.asked |= wave
        if not exact:
            break
        for r in best.where(F.col("place") == most).collect():  # a row for each query of the block
            last[place[r["query_id"]]] = r["similarity"]
        step *= 2
        wave = block.winnable(last, step)
    return best if best is not None else index.sparkSession.createDataFrame([], f"{FOUND}, place int")
