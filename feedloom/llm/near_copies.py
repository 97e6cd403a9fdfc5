"""Near copies by word shingles: SimHash proposes pairs of texts, their exact Jaccard similarity decides.

At a similarity of 0.8 the angle of two sets changes 0.15 of the bits of a SimHash, ten of 64 on average, beyond any ball that can be searched.
So a text has many short fingerprints, each of bits of its own. A text is put under each of them and under the three that it most
likely has if it is edited: those of which the bits that are closest to even are flipped (multi-probe hashing, Lv et al. 2007). The bits of a fingerprint
grow with the logarithm of the table, so that a bucket holds a text or two by chance. What meets in a bucket has to be near by a fingerprint of 64 bits, too.
Large groups meet by pivots, so no group of copies makes pairs by its square. Of a bucket that this leaves in several classes, the texts beside its
largest class meet all of it if they are few; else it is compared completely, in blocks of texts of like sizes, which tell only their least roots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import simhash
from feedloom.llm.embedding_dedup import _least as least_reached
from feedloom.llm.shared import batches_of, checkpointed, components, mapped, slices, written
from feedloom.llm.substrings import hashed, rolled

#: Words of a shingle, and the least Jaccard similarity of near copies.
SHINGLE, LIKE = 5, 0.8
#: Short fingerprints of a text, by their bits from FEWEST_BITS on: so many that two texts of similarity 0.8 (cosine 8/9) miss each other
#: in all of them, with four probes each, in 3 of 10,000 cases (by 60,000 pairs of normal variables for each number of bits).
FEWEST_BITS = 16
TABLES = (17, 20, 23, 26, 31, 36, 41, 49, 55, 66, 73, 87, 100, 113, 138, 154, 185, 211, 255)
#: Short sets, which are found by their parts; those of BARE or fewer shingles have no near copies beyond these.
SHORT, BARE = 14, 11
#: Bits of 64 that near copies differ in, at most: at a similarity of 0.8 more differ in 2 of 100,000 cases.
NEAR = 22
#: Texts of a bucket are all compared with each other up to so many; beyond, each with so many of them.
FEW, PIVOTS = 16, 2
#: Texts of a tile, about, where a large group is compared as a whole, and different shingles that are counted at a time.
TILE, COLUMNS = 1_024, 4_096
#: Rows of a batch of buckets.
BATCH = 50_000

_WORDS = 1 + max(-(-(FEWEST_BITS + i) * n // simhash.BITS) for i, n in enumerate(TABLES))
_FLIP, _TIMES = np.random.default_rng(11).integers(0, 1 << 63, (2, _WORDS), np.uint64)
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different shingles. A-Z are lowered, words are split at the
    ASCII white space; fewer words than a shingle make one shingle."""
    words = (text or b"").lower().split()
    return np.unique(rolled(hashed(words), min(SHINGLE, len(words)), 5)) if words else np.zeros(0, np.uint64)


def width(texts: int) -> tuple[int, int]:
    """(bits, tables): the bits of a short fingerprint for so many texts, two buckets a text, and how many fingerprints of so many bits a text needs."""
    bits = min(max(texts.bit_length() + 1, FEWEST_BITS), FEWEST_BITS + len(TABLES) - 1)
    return bits, TABLES[bits - FEWEST_BITS]


def _bits(found: np.ndarray, words: int) -> np.ndarray:
    """A row of so many words of bits for each shingle."""
    part = (found[:, None] ^ _FLIP[:words]) * _TIMES[:words]
    part ^= part >> np.uint64(32)
    part *= _TIMES[:words]
    part ^= part >> np.uint64(29)
    return np.unpackbits(part.view(np.uint8), axis=1)


def margins(found: np.ndarray, bits: int) -> np.ndarray:
    """For so many bits of SimHash: in how many of the shingles' hashes the bit is set, twice, beyond their number. Above zero the bit is 1."""
    words = -(-bits // simhash.BITS)
    counts = np.zeros(words * simhash.BITS, np.int64)
    for i in range(0, len(found), 255):  # so many fit into bytes; bounded memory for very long texts
        counts += _bits(found[i : i + 255], words).sum(0, dtype=np.uint8)
    return 2 * counts[:bits] - len(found)


def probes(found: np.ndarray, bits: int, tables: int) -> tuple[int, np.ndarray]:
    """A fingerprint of 64 bits, and for each table a short one with the three that come next to it: (fp, flip, flip, flip), the flips as masks, in one list."""
    every = margins(found, simhash.BITS + bits * tables)
    sim = int.from_bytes(np.packbits(every[: simhash.BITS] > 0).tobytes(), "big")
    m = every[simhash.BITS :].reshape(tables, bits)
    size = np.abs(m)
    least = np.argsort(size, axis=1, kind="stable")[:, :3]
    s = np.take_along_axis(size, least, 1) ** 2
    one, two, three = (np.int64(1) << least).T
    both = np.where(s[:, 0] + s[:, 1] < s[:, 2], one | two, three)
    own = (m > 0) @ (np.int64(1) << np.arange(bits))
    return sim, np.stack([own, one, two, both], 1)


def partial(found: np.ndarray) -> np.ndarray:
    """For a set of 4 to SHORT shingles, its SimHash and that of the set without any one of them (from 5 on) and any two (from 10 on), below zero.

    Two sets of at most SHORT together that are near copies share one: they differ in at most two shingles. In so short ones many bits are even, so flips don't find them.
    """
    n = len(found)
    if not 4 <= n <= SHORT:
        return np.zeros(0, np.int64)
    signs = _bits(found, 1).astype(np.int8) * 2 - 1
    gone = [np.zeros((1, simhash.BITS), np.int8), *([signs] if n >= 5 else []), *([signs[i] + signs[i + 1 :] for i in range(n - 1)] if n >= 10 else [])]
    sims = np.packbits(signs.sum(0) - np.concatenate(gone) > 0, axis=1).view(">i8").ravel().astype(np.int64)
    return np.unique(sims | np.int64(-(1 << 63)))


def _own(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0


def marked(docs: DataFrame, bits: int, tables: int) -> DataFrame:
    """(doc_id, h, fp, n, sim, keys, parts) of every row: hashes of the text and of its set of n shingles, the SimHash fingerprint of 64 bits, those of
    ``bits`` bits, ``tables`` of them, packed with the places of the bits that probes flip (see ``held``), and those of a short set's parts."""

    def packed(keys: np.ndarray) -> np.ndarray:
        place = [np.log2(k & -k).astype(np.int64) for k in keys.T[1:]]
        two = keys[:, 3] & (keys[:, 3] - 1) != 0
        return ((((two.astype(np.int64) << 6 | place[2]) << 6 | place[1]) << 6 | place[0]) << 40) | keys[:, 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text"):
            sets = [shingles(t) for t in part["text"]]
            longs = lambda found: np.array(list(found), np.uint64).view(np.int64)
            found = [probes(s, bits, tables) for s in sets]
            yield pd.DataFrame({"doc_id": part["doc_id"], "h": part["h"], "fp": longs(map(_own, sets)), "n": [len(s) for s in sets], "sim": longs(sim for sim, _ in found), "keys": [packed(k) if len(s) > BARE else [] for s, (_, k) in zip(sets, found)], "parts": [partial(s) for s in sets]})

    return mapped(_texts(docs), run, "doc_id long, h long, fp long, n int, sim long, keys array<long>, parts array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) for each of ``wanted`` (fp, doc_id, h: a text that has it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text"):
            yield pd.DataFrame({"fp": part["fp"], "shingles": [shingles(t).view(np.int64) for t in part["text"]]})

    found = mapped(_texts(docs).join(wanted, ["doc_id", "h"]).select("fp", "text"), run, "fp long, shingles array<long>")
    return found.groupBy("fp").agg(F.first("shingles").alias("shingles"))  # equal rows stand once


def held(reps: DataFrame) -> DataFrame:
    """(key, fp, sim): the buckets of each of ``reps`` (fp, sim, keys, parts), the four probes of each of its short fingerprints and its parts."""
    one, two, three = (F.expr(f"shiftleft(1L, cast(shiftright(k, {at}) & 63 as int))") for at in (40, 46, 52))
    both = F.when(F.expr("(shiftright(k, 58) & 1) = 1"), one.bitwiseOR(two)).otherwise(three)
    own = F.expr(f"shiftleft(cast(t as bigint), 40) | (k & {(1 << 40) - 1})")
    flipped = F.array(own, own.bitwiseXOR(one), own.bitwiseXOR(two), own.bitwiseXOR(both))
    probed = reps.select("fp", "sim", F.posexplode("keys").alias("t", "k")).select(F.explode(flipped).alias("key"), "fp", "sim")
    return probed.unionByName(reps.select(F.explode("parts").alias("key"), "fp", "sim"))


def met(rows: DataFrame) -> DataFrame:
    """(a, b, key, sim) of what meets in the buckets of ``rows`` (key, fp, sim).

    Of a bucket that up to FEW are in, all pairs (a, b) that are NEAR or share a part. Of one with more, each with PIVOTS of them at most, picked
    anew for each bucket, so that no group makes pairs by its square; its members come, too, as (a, null) with their bucket and fingerprint.
    """

    def pairs(key: np.ndarray, fp: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that pair, in whole buckets one after another, and whether a row is in a large one."""
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        large, start = np.repeat(sizes > FEW, sizes), np.repeat(first, sizes)
        at = np.arange(len(key))
        left, right = [], []
        for step in range(1, FEW):
            i = np.flatnonzero((at - start >= step) & ~large)
            left.append(i - step), right.append(i)
        for slot in range(PIVOTS):
            i = np.flatnonzero(large & (at - start > slot))
            left.append(start[i] + slot), right.append(i)
        i, j = np.concatenate(left), np.concatenate(right)
        near = (np.bitwise_count(sim[i].view(np.uint64) ^ sim[j].view(np.uint64)) <= NEAR) | (key[i] < 0)
        return i[near], j[near], large

    def frame(parts: list[pd.DataFrame]) -> pd.DataFrame:
        key, fp, sim = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("key", "fp", "sim"))
        i, j, large = pairs(key, fp, sim)
        every = np.flatnonzero(large)
        out = pd.DataFrame({"a": np.append(np.minimum(fp[i], fp[j]), fp[every]), "b": pd.array(np.append(np.maximum(fp[i], fp[j]), fp[every]), "Int64"), "key": np.append(key[i], key[every]), "sim": np.append(sim[i], sim[every])})
        out.loc[len(i) :, "b"] = pd.NA
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []  # the bucket that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if open_ and (last or open_[0]["key"].iloc[0] != key[0]):
                yield frame([*open_, batch.iloc[:last]])
                open_ = []
            elif last:
                yield frame([batch.iloc[:last]])
            open_.append(batch.iloc[last:])
        if open_:
            yield frame(open_)

    dealt = rows.repartition("key").sortWithinPartitions("key", F.xxhash64("fp", "key"))
    with batches_of(rows.sparkSession, BATCH):
        return written(dealt.mapInPandas(run, "a long, b long, key long, sim long"))


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of fingerprints in ``reps`` (fp, doc_id, h, n) whose shingles' Jaccard similarity is LIKE or more."""
    n_of = lambda x: reps.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"))
    pairs = pairs.join(n_of("a"), "a").join(n_of("b"), "b")
    # the sizes alone rule many out before a set moves
    pairs = checkpointed(pairs.where(F.least("n_a", "n_b") >= LIKE * F.greatest("n_a", "n_b")).select("a", "b"))
    some = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    sets = checkpointed(shingle_sets(docs, reps.select("fp", "doc_id", "h").join(some, "fp", "left_semi")))
    return like_pairs(sets, pairs)


def like_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets in ``sets`` (fp, shingles) have a Jaccard similarity of LIKE or more."""
    left, right = (sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    lengths = F.size("of_a"), F.size("of_b")
    like = both >= LIKE * (lengths[0] + lengths[1] - both)
    return pairs.join(left, "a").join(right, "b").where(like).select("a", "b")


def apart(many: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``classes`` (id, component) leave apart in the large buckets ``many`` (fp, key, sim): (a, b), pairs to be compared, and (fp, key), buckets to be compared completely.

    Where up to FEW of a bucket aren't in its largest class, they meet all of it that is NEAR and of another class; chance brings such texts into buckets of copies.
    """
    of = checkpointed(many.join(classes, F.col("fp") == F.col("id"), "left").select("fp", "key", "sim", F.coalesce("component", "fp").alias("component")))
    sizes = of.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top"))
    mixed = sizes.select("key", (F.col("n") - F.col("top.c")).alias("rest"), F.col("top.component").alias("top")).where("rest > 0")
    mixed = checkpointed(of.join(mixed, "key"))
    some = mixed.where(F.col("rest") <= FEW)
    beside = some.where("component <> top").select("key", F.col("fp").alias("one"), F.col("sim").alias("sim_one"), F.col("component").alias("component_one"))
    near = (F.col("component") != F.col("component_one")) & ((F.col("key") < 0) | (F.bit_count(F.col("sim").bitwiseXOR(F.col("sim_one"))) <= NEAR))
    pairs = some.select("key", "fp", "sim", "component").join(beside, "key").where(near).select(F.least("fp", "one").alias("a"), F.greatest("fp", "one").alias("b")).distinct()
    return checkpointed(pairs), mixed.where(F.col("rest") > FEW).select("fp", "key")


def tiled(sets: DataFrame) -> DataFrame:
    """``sets`` (fp, part, shingles) in every pair of tiles that they have to be compared in: (part, la, lb, x, y, right, fp, shingles).

    Sets of one part and like sizes make tiles of about TILE. Two sets of similarity LIKE have sizes within that ratio, so
    their classes of size, la and lb, are the same or neighbours.
    """
    sized = sets.withColumn("l", F.floor(F.log(F.size("shingles")) / -math.log(LIKE)).cast("int"))
    tiles = checkpointed(sized.groupBy("part", "l").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    near = lambda step, name: tiles.select("part", (F.col("l") - step).alias("l"), F.col("tiles").alias(name))
    for step, name in ((0, "own"), (1, "above"), (-1, "below")):
        sized = sized.join(near(step, name), ["part", "l"], "left")
    me, l = F.pmod(F.xxhash64("fp"), F.col("own")).cast("int"), F.col("l")
    others = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda la, lb, x, y, right: F.struct(la.alias("la"), lb.alias("lb"), x.alias("x"), y.alias("y"), right.alias("right"))
    met = F.concat(
        F.transform(others("own"), lambda o: at(l, l, F.least(me, o), F.greatest(me, o), me > o)),
        F.transform(others("above"), lambda o: at(l, l + 1, me, o, F.lit(False))),
        F.transform(others("below"), lambda o: at(l - 1, l, o, me, F.lit(True))),
    )
    return sized.select("part", F.explode(met).alias("at"), "fp", "shingles").select("part", "at.*", "fp", "shingles")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, worked out for so many different elements at a time."""
    sides = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*sides)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for sets, every in zip((left, right), sides):
        column = np.minimum(np.searchsorted(both, every), max(len(both) - 1, 0))
        known = both[column] == every if len(both) else np.zeros(len(every), bool)
        order = np.argsort(column[known], kind="stable")
        places.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[known][order], column[known][order]))
    for first in range(0, len(both), COLUMNS):
        some = []
        for (row, column), n in zip(places, out.shape):
            a, b = np.searchsorted(column, (first, first + COLUMNS))
            dense = np.zeros((n, min(COLUMNS, len(both) - first)), np.float32)
            dense[row[a:b], column[a:b] - first] = 1
            some.append(dense)
        out += some[0] @ some[1].T
    return out


def complete_links(sets: DataFrame) -> DataFrame:
    """(a, b): links that join all of ``sets`` (fp, part, shingles) of one part whose similarity is LIKE or more. Each two of like sizes are compared, in blocks; of a pair of tiles only each set's least root there is told."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("fp").sort_values("fp", ignore_index=True)
        ids, held = rows["fp"].to_numpy(), rows["shingles"].to_list()
        same = bool(((rows["la"] == rows["lb"]) & (rows["x"] == rows["y"])).all())
        right = rows["right"].to_numpy(bool)
        i, j = [np.arange(len(rows))] * 2 if same else [np.flatnonzero(~right), np.flatnonzero(right)]
        if not len(i) or not len(j):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        both = _shared([held[k] for k in i], [held[k] for k in j]).astype(np.float64)
        n = np.array([len(x) for x in held])
        u, v = np.nonzero(both >= LIKE * (n[i][:, None] + n[j][None, :] - both))
        root = least_reached(len(rows), i[u], j[v])
        some = root != np.arange(len(rows))
        return pd.DataFrame({"a": ids[some], "b": ids[root[some]]})

    return tiled(sets).groupBy("part", "la", "lb", "x", "y").applyInPandas(compare, "a long, b long")


def classed(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, component) of the fingerprints in ``reps`` (fp, doc_id, h, n, sim, keys, parts) that are like others: the least one that links between proposed pairs reach.

    Where the pivots leave a large bucket in several classes, its texts meet as ``apart`` tells; buckets that share a text make one part.
    """
    found = met(held(reps))
    links = verified(docs, reps, found.where("b is not null").select("a", "b").distinct())
    classes = checkpointed(components(links))
    many = found.where("b is null").select(F.col("a").alias("fp"), "key", "sim")
    if many.isEmpty():
        return classes
    pairs, rest = apart(many, classes)
    linked = classes.select(F.col("id").alias("a"), F.col("component").alias("b"))
    if not pairs.isEmpty():
        linked = linked.union(verified(docs, reps, pairs))
    if not rest.isEmpty():
        heads = rest.groupBy("key").agg(F.min("fp").alias("b"))
        parts = checkpointed(components(rest.join(heads, "key").select(F.col("fp").alias("a"), "b")).select(F.col("id").alias("fp"), F.col("component").alias("part")))
        sets = checkpointed(shingle_sets(docs, reps.where("n > 0").select("fp", "doc_id", "h").join(parts, "fp", "left_semi")).join(parts, "fp"))
        linked = linked.union(complete_links(sets))
    return components(linked)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h, component_id, kept) of each row's (doc_id, h: the xxHash64 of the text) once: component_id is the least doc_id
    that links between near copies reach, kept whether it is the one of its class that stays: of those with that id the one of least h.

    Rows of one id and different texts are different documents. Null and empty texts are copies of each other; rows with a null
    doc_id are left out; an empty table gives no rows.
    """
    docs = docs.where("doc_id is not null")
    marks = checkpointed(marked(docs, *width(docs.count())))
    first = F.struct("doc_id", "h")
    reps = checkpointed(marks.groupBy("fp").agg(F.min(first).alias("at"), *(F.first(c).alias(c) for c in ("n", "sim", "keys", "parts"))).select("fp", "at.*", "n", "sim", "keys", "parts"))
    found = classed(docs, reps)
    classes = checkpointed(reps.join(found, reps["fp"] == found["id"], "left").select("fp", F.coalesce("component", "fp").alias("root"), first.alias("at")))
    heads = classes.groupBy("root").agg(F.min("at").alias("head"))
    whole = checkpointed(classes.join(heads, "root").select("fp", "head"))
    return marks.select("doc_id", "h", "fp").distinct().join(whole, "fp").select("doc_id", "h", F.col("head.doc_id").alias("component_id"), (first == F.col("head")).alias("kept"))
