"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are turned to their principal axes and dealt over tiles, the leaves of a tree of median cuts along the
leading ones. A tile's box tells the least distance to it, so a vector meets only the tiles that something like it can
be in. In a pair of tiles products are accumulated along the axes, the leading ones first; the rest of a product is
at most the product of the suffix norms, and a pair is given up where even that can't reach the least cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.shared import checkpointed, components, written

#: Vectors of a tile, about, and at most; a leaf with more makes several tiles.
TILE, MOST_TILE = 2_048, 8_192
#: Numbers of the vectors that axes and tree are found on, about, and of these vectors in a leaf at least. They change speed only, never a result.
SAMPLE, LEAF = 1 << 22, 16
#: Leading axes that the tree cuts and boxes bound.
AXES = 8
#: Parts of the rotated dimensions that are accumulated one after another.
STEPS = (0.5, 0.75, 1.0)
SLACK = 1e-9
#: Tiles for vectors of lengths that no sampled vector has.
RARE = 256


def _usable() -> Column:
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)


def signed(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, s1, s2) of the usable vectors: x as it is, with two hashes of its doubles. Null and zero vectors and those with null or non-finite components are left out, as are null ids."""
    plain = F.transform("embedding", lambda v: v + F.lit(0).cast("float"))  # -0.0 is 0.0
    return vectors.where(_usable()).select("vec_id", plain.alias("x")).withColumns({"s1": F.xxhash64("x", F.lit(1)), "s2": F.xxhash64("x", F.lit(2))})


def distinct(marked: DataFrame) -> DataFrame:
    """(id, size, dim, x): each different vector once, under its least vec_id, with its number of copies. Copies meet before the shuffle."""
    return marked.groupBy("s1", "s2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("x").alias("x")).select("id", "size", F.size("x").alias("dim"), "x", "s1", "s2")


@dataclass
class Tree:
    """Principal axes of vectors of one length, and cuts along the leading ones; node k goes on to nodes below[k] (0: a leaf)."""

    axes: np.ndarray
    axis: list[int]
    cut: list[float]
    below: list[tuple[int, int]]
    leaf: list[int]
    leaves: int

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True) @ self.axes[:, :AXES]

    def place(self, at: np.ndarray) -> np.ndarray:
        """The leaf of each of the coordinates."""
        node = np.zeros(len(at), np.int64)
        axis, cut, below = np.array(self.axis), np.array(self.cut), np.array(self.below)
        while len(go := np.flatnonzero(below[node, 0])):
            k = node[go]
            node[go] = below[k, (at[go, axis[k]] > cut[k]).astype(np.int64)]
        return np.array(self.leaf)[node]


def grown(x: np.ndarray, fewest: int) -> Tree:
    """A tree over the sample x, whose leaves have ``fewest`` of it or more."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree = Tree(np.linalg.eigh(unit.T @ unit)[1][:, ::-1], [], [], [], [], 0)

    def node(at: np.ndarray) -> int:
        k = len(tree.axis)
        for part, empty in ((tree.axis, 0), (tree.cut, 0.0), (tree.below, (0, 0)), (tree.leaf, -1)):
            part.append(empty)
        if len(at) >= 2 * fewest:
            axis = int(np.ptp(np.quantile(at, (0.1, 0.9), axis=0), axis=0).argmax())
            cut = float(np.median(at[:, axis]))
            right = at[:, axis] > cut
            if fewest <= right.sum() <= len(at) - fewest:
                tree.axis[k], tree.cut[k] = axis, cut
                tree.below[k] = (node(at[~right]), node(at[right]))
                return k
        tree.leaf[k] = tree.leaves
        tree.leaves += 1
        return k

    node(tree.coordinates(x))
    return tree


def trees(unique: DataFrame, seed: int = 5) -> dict[int, Tree]:
    """By length of vector, a tree from a bounded sample."""
    n, numbers = unique.agg(F.count("*"), F.sum("dim")).first()
    if not n:
        return {}
    rate = min(1.0, SAMPLE / numbers)
    rows = unique.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * rate)).select("dim", "x").limit(1 + int(2 * rate * n)).collect()
    fewest = max(LEAF, round(TILE * len(rows) / n))
    return {dim: grown(np.array([r["x"] for r in rows if r["dim"] == dim], np.float64), fewest) for dim in {r["dim"] for r in rows}}


def _by_dim(part: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for dim, rows in part.groupby("dim"):
        yield dim, rows, np.stack(rows["x"]).astype(np.float64)


def boxes(unique: DataFrame, found: dict[int, Tree]) -> pd.DataFrame:
    """(dim, leaf, n, lo, hi): of each leaf the number of its vectors and the bounds of their coordinates. The driver gets a row for each leaf and axis."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for dim, _, x in _by_dim(part):
                if dim in found:
                    at = found[dim].coordinates(x)
                    by = pd.DataFrame(at).groupby(found[dim].place(at))
                    lo, hi, n = by.min(), by.max(), by.size()
                    for axis in lo.columns:
                        yield pd.DataFrame({"dim": dim, "leaf": lo.index, "axis": axis, "lo": lo[axis].to_numpy(), "hi": hi[axis].to_numpy(), "n": n.to_numpy()})

    rows = unique.select("dim", "x").mapInPandas(run, "dim int, leaf int, axis int, lo double, hi double, n long")
    return rows.groupBy("dim", "leaf", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toPandas()


def tiled(unique: DataFrame, found: dict[int, Tree], reach: float) -> DataFrame:
    """(id, size, dim, raw, tile, other, right): each vector in every pair of tiles that it has to be compared in; right: it is of the pair's second tile.

    A vector meets the tiles whose box is within ``reach`` of it.
    """
    bounds = boxes(unique, found)
    layout: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    tiles = RARE
    for dim, rows in bounds.groupby("dim"):
        wide = rows.pivot(index="leaf", columns="axis", values=["lo", "hi"]).reindex(range(found[dim].leaves))
        n = rows.groupby("leaf")["n"].max().reindex(range(found[dim].leaves)).fillna(0)
        parts = np.maximum(1, -(-n // MOST_TILE)).to_numpy().astype(np.int64)
        layout[dim] = (wide["lo"].fillna(9).to_numpy(), wide["hi"].fillna(-9).to_numpy(), tiles + np.cumsum(parts) - parts, parts)
        tiles += int(parts.sum())
    shared = unique.sparkSession.sparkContext.broadcast((found, layout))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_trees, all_tiles = shared.value
        for batch in batches:
            for dim, rows, x in _by_dim(batch):
                kind = "f4" if rows["x"].iloc[0].dtype == np.float32 else "f8"
                raw = np.array([v.tobytes() for v in x.astype(kind)], object)
                info = {"id": rows["id"].to_numpy(), "size": rows["size"].to_numpy(), "raw": raw}
                if dim not in all_tiles:
                    yield pd.DataFrame(info | {"dim": dim, "tile": dim % RARE, "other": dim % RARE, "right": False})
                    continue
                tree, (lo, hi, start, parts) = all_trees[dim], all_tiles[dim]
                at = tree.coordinates(x)
                leaf = tree.place(at)
                own = start[leaf] + info["id"] % parts[leaf]
                for a in range(0, len(x), 512):
                    part = slice(a, a + 512)
                    far = np.zeros((len(at[part]), len(lo)))
                    for axis in range(lo.shape[1]):
                        c = at[part, axis : axis + 1]
                        far += np.maximum(0, np.maximum(lo[:, axis] - c, c - hi[:, axis])) ** 2
                    i, j = np.nonzero(far <= reach**2)
                    i, first, n = np.repeat(i, parts[j]), np.repeat(start[j], parts[j]), parts[j]
                    other = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    me = own[part][i]
                    yield pd.DataFrame({k: v[part][i] for k, v in info.items()} | {"dim": dim, "tile": np.minimum(me, other), "other": np.maximum(me, other), "right": me > other})

    return unique.select("id", "size", "dim", "x").mapInPandas(run, "id long, size long, dim int, raw binary, tile long, other long, right boolean")


def _linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of a and b whose cosine is at least ``least``.

    Products are accumulated along the principal axes, in blocks of rows; after each part the rest of a pair's product is at
    most the product of their suffix norms, and only pairs that can still reach the least go on.
    """
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)]
    u, v = (x @ axes for x in unit)
    stops = sorted({max(1, int(u.shape[1] * s)) for s in STEPS})
    tail = lambda x, k: np.sqrt(np.maximum(0, 1 - (x[:, :k] ** 2).sum(1)))
    left, right = [], []
    for at in range(0, len(u), 1024):
        block = u[at : at + 1024]
        part = block[:, : stops[0]] @ v[:, : stops[0]].T
        rest = np.outer(tail(block, stops[0]), tail(v, stops[0]))
        if same:
            rest[np.arange(len(block))[:, None] + at >= np.arange(len(v))[None, :]] = -9
        i, j = np.nonzero(part + rest >= least - SLACK)
        dot = part[i, j]
        for k, stop in zip(stops, stops[1:]):
            dot = dot + np.einsum("nd,nd->n", block[i, k:stop], v[j, k:stop])
            go = dot + tail(block, stop)[i] * tail(v, stop)[j] >= least - SLACK
            i, j, dot = i[go], j[go], dot[go]
        left.append(i + at)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    exact = np.einsum("nd,nd->n", a[i], b[j]) / (np.linalg.norm(a[i], axis=1) * np.linalg.norm(b[j], axis=1))
    return i[exact >= least], j[exact >= least]


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place that the links (i, j) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(unique: DataFrame, least: float) -> DataFrame:
    """(id, links, root): by pair of tiles, each linked vector's number of links there, copies of
    the other counted, and the least id that it reaches there. No list of pairs is written."""
    found = trees(unique)
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    width = {dim: tree.axes for dim, tree in found.items()}

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, rows in part.groupby("dim"):
            rows = rows.sort_values("id", ignore_index=True)
            same = bool((rows["tile"] == rows["other"]).all())
            sides = [np.arange(len(rows))] * 2 if same else [np.flatnonzero(~rows["right"]), np.flatnonzero(rows["right"])]
            if not len(sides[0]) or not len(sides[1]):
                continue
            raw = b"".join(rows["raw"])
            x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(rows) else np.float64).reshape(len(rows), dim).astype(np.float64)
            i, j = _linked(x[sides[0]], x[sides[1]], width.get(dim, np.eye(dim)), least, same)
            i, j = sides[0][i], sides[1][j]
            sizes = rows["size"].to_numpy()
            links = np.bincount(i, sizes[j], len(rows)) + np.bincount(j, sizes[i], len(rows))
            ids, low, some = rows["id"].to_numpy(), _least(len(rows), i, j), links > 0
            out.append(pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "root": ids[low][some]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")

    return tiled(unique, found, reach).groupBy("tile", "other").applyInPandas(compare, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Two vectors of one dimension are linked when their cosine, in double precision, is at least
    ``least``. n_links: other rows linked directly, copies each counted; component_id: the
    least vec_id that links reach, itself included; kept: vec_id = component_id. Vectors that
    are null, zero, or hold null or non-finite components link with nothing and are kept; a
    null vec_id links nothing and has a null component. Rows of equal vec_id and vector count as
    copies of each other. An empty table gives no rows; other columns are ignored.
    """
    marked = signed(vectors.select("vec_id", "embedding"))
    unique = written(distinct(marked))
    found = checkpointed(tile_links(unique, least).groupBy("id", "root").agg(F.sum("links").alias("links")))
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    summed = unique.select("id", "size", "s1", "s2").join(degree, "id", "left").join(classes, "id", "left")
    summed = checkpointed(summed.select("s1", "s2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    # only ids and hashes travel to the result
    usable = marked.select("vec_id", "s1", "s2").join(summed, ["s1", "s2"]).select("vec_id", "n_links", "component_id")
    rest = vectors.select("vec_id", "embedding").where(~F.coalesce(_usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
