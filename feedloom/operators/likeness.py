"""Likeness of many pairs of sets, exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.storage import tabled

#: The square of it is about the pairs of sets that are compared together.
TILE = 128


def compared(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(scope, a, b, similarity): the ``pairs`` (scope, a, b) of ``classes`` whose Jaccard likeness reaches ``least``.

    Alike sets come in groups, so pairs go by the least set that a's is paired with, and a set moves once for each tile of
    such a group and not for each of its pairs. Words move as hashes, with a seed that gives no two words the same.
    """
    both = pairs.select("scope", F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("scope", F.col("b").alias("id"), F.col("a").alias("other")))
    first = tabled(both.groupBy("scope", "id").agg(F.min("other").alias("other")).select("scope", "id", F.least("id", "other").alias("head")))
    sets = tabled(classes.select("scope", F.col("class_id").alias("id"), "words").join(first.select("scope", "id"), ["scope", "id"], "left_semi"))
    words, seed = tabled(sets.select(F.explode("words").alias("word")).distinct()), 0
    while words.groupBy(F.xxhash64("word", F.lit(seed))).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        seed += 1
    headed = pairs.join(first.select("scope", F.col("id").alias("a"), "head"), ["scope", "a"])
    tiles = headed.groupBy("scope", "head").agg(F.ceil(F.sqrt(F.count("*")) / TILE).alias("tiles"))
    number = max(1, -(-pairs.count() // TILE**2))
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("tiles"))
    dealt = tabled(headed.join(tiles, ["scope", "head"]).select("scope", "a", "b", F.pmod(F.xxhash64("scope", "head", tile("a"), tile("b")), F.lit(number)).alias("place")))
    # columns apart from those of ``dealt``
    moved = dealt.select((F.col("place") + 0).alias("at"), F.col("scope").alias("of"), F.explode(F.array("a", "b")).alias("id")).distinct()
    moved = moved.join(sets.select(F.col("scope").alias("of"), "id", F.transform("words", lambda w: F.xxhash64(w, F.lit(seed))).alias("h")), ["of", "id"])

    def compare(own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        h = dict(zip(zip(met["of"], met["id"]), met["h"]))
        likeness = np.empty(len(own))
        for k, (scope, a, b) in enumerate(zip(own["scope"], own["a"], own["b"])):
            x = np.concatenate([h[scope, a], h[scope, b]])
            x.sort()
            shared = np.count_nonzero(x[1:] == x[:-1])
            likeness[k] = shared / (len(x) - shared)
        return own[["scope", "a", "b"]].assign(similarity=likeness)[likeness >= least]

    schema = f"scope {classes.schema['scope'].dataType.simpleString()}, a long, b long, similarity double"
    return dealt.groupBy("place").cogroup(moved.groupBy("at")).applyInPandas(compare, schema)
