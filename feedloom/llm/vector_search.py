"""Exact top-k search by inner product over a pivot-distance index.

With one more coordinate, sqrt(M^2 - |x|^2), M the greatest norm, stored vectors lie on a sphere, and the larger the product
with a query, the nearer they are to it: |q - x|^2 = |q|^2 + M^2 - 2qx. Each vector is keyed by its nearest pivot and its distance
from it; a shelf of the index holds vectors of one pivot in the order of that distance, cut into rings. By the triangle
inequality a vector is no nearer to the query than their distances from the pivot differ. A query therefore begins at the ring
where it would lie itself, goes on to the rings around it, and ends where even that difference is too large for the last of its best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.shared import batches_of, written

#: Numbers of the vectors that pivots are found on, about, and pivots at most. They change speed only, never a result.
SAMPLE, PIVOTS = 1 << 21, 256
#: Vectors of a ring; numbers of a shelf and of a block of queries, about.
RING, SHELF, BLOCK = 256, 1 << 20, 1 << 20
#: Hits that a task holds before it keeps the best of each query.
HITS = 1 << 19
#: Relative width of what rounding can do to a bound.
SLACK = 1e-9
#: Stands for a null id, which comes last among equals.
NO_ID = (1 << 63) - 1
SHELVES = "dim int, pivot int, ids array<long>, rows array<long>, away array<double>, x array<long>"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(row, vec_id, dim, x): floor(scale * x) of the components of the usable vectors, each row with a number of its own."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    df = vectors.where(F.col("embedding").isNotNull() & ~bad).select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), F.size("embedding").alias("dim"), whole.alias("x"))
    return df.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def pivots(unique: DataFrame, seed: int = 7) -> dict[int, np.ndarray]:
    """By length of vector, pivots: means of a bounded sample by a few rounds of nearest means."""
    n, numbers = unique.agg(F.count("*"), F.sum("dim")).first()
    rate = min(1.0, SAMPLE / max(numbers or 0, 1))
    rows = unique.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * rate)).select("dim", "x").limit(1 + int(2 * rate * n)).collect()
    found = {}
    for dim in {r["dim"] for r in rows} - {0}:
        x = np.array([r["x"] for r in rows if r["dim"] == dim], np.float64)
        rng = np.random.default_rng(seed)
        means = x[rng.choice(len(x), min(len(x), PIVOTS, max(1, round(math.sqrt(n) / 4))), replace=False)]
        for _ in range(4):
            near = _apart(x, means).argmin(1)
            sums = np.zeros_like(means)
            np.add.at(sums, near, x)
            counts = np.bincount(near, minlength=len(means))
            means[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        found[dim] = means
    return found


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T))


def _raised(x: np.ndarray, most: float) -> np.ndarray:
    """x with the coordinate that puts it on the sphere of radius sqrt(most)."""
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x**2).sum(1)))])


def _at(found: dict[int, np.ndarray], dim: int, most: float) -> np.ndarray:
    """The pivots for vectors of a length; one at the centre where the sample has none."""
    return _raised(found[dim], most) if dim in found else np.zeros((1, dim + 1))


def shelved(rows: DataFrame, found: dict[int, np.ndarray], most: float) -> DataFrame:
    """The index: a row for each shelf. Vectors go to shelves by ranges of (length, pivot, distance), so a pivot with many has many shelves."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                away = _apart(_raised(np.stack(part["x"]).astype(np.float64), most), _at(shared.value, dim, most))
                near = away.argmin(1)
                yield part.assign(pivot=near, away=away[np.arange(len(near)), near])

    def shelf(parts: list[pd.DataFrame]) -> pd.DataFrame:
        all_rows = pd.concat(parts)
        return pd.DataFrame({"dim": all_rows["dim"].iloc[:1], "pivot": all_rows["pivot"].iloc[0], "ids": [all_rows["vec_id"].to_numpy()], "rows": [all_rows["row"].to_numpy()], "away": [all_rows["away"].to_numpy()], "x": [np.concatenate(all_rows["x"].to_list())]})

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for (dim, pivot), part in batch.groupby(["dim", "pivot"], sort=False):
                most_rows = max(1, SHELF // max(dim, 1))
                if held and (held[0]["dim"].iloc[0], held[0]["pivot"].iloc[0]) != (dim, pivot):
                    yield shelf(held)
                    held = []
                while len(part):
                    room = most_rows - sum(map(len, held))
                    held.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if len(held[-1]) == room:
                        yield shelf(held)
                        held = []
        if held:
            yield shelf(held)

    df = written(rows.select("row", "vec_id", "dim", "x").mapInPandas(keyed, "row long, vec_id long, dim int, x array<long>, pivot int, away double"))
    key = ("dim", "pivot", "away", "row")
    return df.repartitionByRange(*key).sortWithinPartitions(*key).mapInPandas(filled, SHELVES)


class Best:
    """The best hits so far of each of n queries."""

    def __init__(self, n: int, most: int, least: np.ndarray):
        self.most, self.least = most, least.copy()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((query, score, ids))
        self.held += len(query)
        if self.held > HITS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the best of each query, equal scores by id, and raises what a hit must reach."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        q, s, i = map(np.concatenate, zip(*self.parts))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.most - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        keep = place < self.most
        self.parts = [(q[keep], s[keep], i[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond 64 bits at their ends."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if largest < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Block:
    """A bounded number of queries of one length, with their distances from the pivots."""

    def __init__(self, rows: list, dim: int, found: dict[int, np.ndarray], most: float):
        self.rows = np.array([r["row"] for r in rows], np.int64)
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.x = np.array([r["x"] for r in rows], np.int64).reshape(len(rows), dim)
        flat = self.x.astype(np.float64)
        self.size = (flat**2).sum(1) + most
        self.away = _apart(np.column_stack([flat, np.zeros(len(flat))]), _at(found, dim, most))
        self.home = self.away.argmin(1)

    def expand(self, shelf: pd.Series, best: Best, who: np.ndarray, rings_each: int | None = None) -> int:
        """Adds to ``best`` what the queries ``who`` find on a shelf, ring by ring from their own distance on; returns the number of products."""
        away, ids, rows = shelf["away"], shelf["ids"], shelf["rows"]
        x = np.asarray(shelf["x"], np.int64).reshape(len(ids), self.x.shape[1])
        cuts = np.arange(0, len(ids), RING)
        low, high = away[cuts], away[np.minimum(cuts + RING, len(ids)) - 1]
        mine = self.away[who, shelf["pivot"]]
        # how far each query is from a ring, at least: zero within it, more the further out
        off = np.maximum(0, np.maximum(low[None, :] - mine[:, None], mine[:, None] - high[None, :]))
        order = np.argsort(off, axis=1, kind="stable")
        live, made = np.arange(len(who)), 0
        for step in range(len(cuts) if rings_each is None else min(rings_each, len(cuts))):
            ring = order[live, step]
            q = who[live]
            bound = (self.size[q] - off[live, ring] ** 2) / 2
            reach = bound + SLACK * (self.size[q] + 1) >= best.least[q]
            live, ring = live[reach], ring[reach]  # the rings beyond are further off still
            if not len(live):
                break
            for r in np.unique(ring):
                some = live[ring == r]
                part = slice(cuts[r], cuts[r] + RING)
                for at in range(0, len(some), 2_048):
                    q = who[some[at : at + 2_048]]
                    score = _products(self.x[q], x[part])
                    made += score.size
                    hit = score >= best.least[q][:, None]
                    hit &= rows[part][None, :] != self.rows[q][:, None]
                    i, j = np.nonzero(hit)
                    best.add(q[i], score[i, j], ids[part][j])
            best.settle()
        return made


def _run(index: DataFrame, block: Block, dim: int, most: int, least: np.ndarray, home: bool) -> DataFrame:
    """(query, score, vec_id) of the best that tasks find; home: only on the shelves of each query's nearest pivot, in its first rings there."""
    shared = index.sparkSession.sparkContext.broadcast((block, least))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, floor = shared.value
        best = Best(len(own.rows), most, floor)
        for batch in batches:
            for _, shelf in batch.iterrows():
                who = np.flatnonzero(own.home == shelf["pivot"]) if home else np.arange(len(own.rows))
                if len(who):
                    own.expand(shelf, best, who, 2 if home else None)
        q, s, i = best.settle()
        yield pd.DataFrame({"query": q, "score": s, "vec_id": i})

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = index.where(F.col("dim") == dim).mapInPandas(run, "query long, score long, vec_id long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def searched(vectors: DataFrame, every: int = 20, most: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``
    the ``most`` other rows of highest inner product, all components x as floor(64 * x), equal ones by ascending vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do vectors of another length than the query's
    for it. Every row but the query's own is a candidate: rows that repeat an id are too, and as queries have a list each. A row
    without an id is no query, but a candidate of null vec_id, which comes last among equals. Products beyond 64 bits count as the
    largest number there is. An empty table gives no rows; other columns are ignored.
    """
    rows = written(quantised(vectors.select("vec_id", "embedding")))
    reach = rows.agg(F.max("norm2")).first()[0] or 0.0
    found = pivots(rows)
    index = written(shelved(rows, found, reach))
    asked = rows.where((F.col("vec_id") != NO_ID) & (F.pmod(F.col("vec_id"), F.lit(every)) == 0))
    parts = []
    with batches_of(rows.sparkSession, 16):
        for dim, b, blocks in [(r["dim"], b, r["blocks"]) for r in _blocks(asked) for b in range(r["blocks"])]:
            chosen = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "vec_id", "x").collect()
            block = Block(chosen, dim, found, reach)
            least = np.full(len(block.rows), -(1 << 63), np.int64)
            for r in _run(index, block, dim, most, least, True).where(F.col("rank") == most).collect():  # a row for each query of the block
                least[r["query"]] = r["score"]
            names = rows.sparkSession.createDataFrame(pd.DataFrame({"query": np.arange(len(block.ids)), "query_id": block.ids}), "query long, query_id long")
            parts.append(written(_run(index, block, dim, most, least, False).join(names, "query").select("query_id", "rank", "vec_id", "score")))
    if not parts:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("row").alias("score")).limit(0)
    return reduce(DataFrame.unionByName, parts).select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def _blocks(asked: DataFrame) -> list:
    """How many blocks the queries of each length make."""
    return asked.groupBy("dim").agg(F.ceil(F.count("*") * F.greatest(F.col("dim"), F.lit(1)) / BLOCK).cast("int").alias("blocks")).collect()
