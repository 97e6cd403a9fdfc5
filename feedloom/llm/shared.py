"""Pieces that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.storage import batches_of, shared_folder, spread, stored  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, stored in the shared folder."""
    return stored(df)


def written(df: DataFrame, **options) -> DataFrame:
    """df as a compressed table in the shared folder, read again: the lineage is cut, in fewer bytes than a checkpoint has. options: the writer's."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a batch that a Python worker is handed.
ROWS = 1_000


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInPandas(run, schema) by batches of ROWS rows at most, so that a worker holds few whole texts at a time. The session keeps the setting."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return df.mapInPandas(run, schema)


def slices(batches: Iterator[pd.DataFrame], column: str, most: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """The batches cut so that the texts (or bytes) of a slice stay near ``most`` characters; a longer row stands alone."""
    for batch in batches:
        lengths = batch[column].str.len().fillna(0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // most)) + 1
        at = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(at, at[1:]):
            if b > a:
                yield batch.iloc[a:b].reset_index(drop=True)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b: long): the least id that links reach.

    Alternating large and small stars (Kiveris et al. 2014). A round is two minimum aggregates,
    which combine before the shuffle, and two equi-joins against a stored table, which adaptive
    execution can split where one id is a hub. Nulls and loops link nothing; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    # written tables tell their sizes; a checkpoint keeps its plan's estimate, which such joins would square round by round
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = checkpointed(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = written(small.select("e.*").where("hi != lo").distinct())
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
