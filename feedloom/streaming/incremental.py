"""Incremental stages as streams: upserts by micro-batch, exact duplicates, windows over events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.ingest import latest, upserted

#: Parts that a table of upserts is cut into by a hash of the key; a batch writes those again that it has keys of.
PARTS = 64


def upsert_stream(arriving: DataFrame, table: str, checkpoint: str, keys: list[str], order: str, parts: int = PARTS) -> StreamingQuery:
    """Each micro-batch's newest rows upserted into the folder ``table``, which ``upserts`` reads.

    A batch writes the parts that its keys fall into under its own id, then the list of which batch
    each part was last written by. A batch that is run again after a failure reads the lists of
    earlier ones only and writes the same again. ``parts`` stays the same for a table's life; the list
    is as long.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        new = latest(batch, keys, order).withColumn("part", _part(keys, parts))
        touched = {r["part"] for r in new.select("part").distinct().collect()}
        places = _places(spark, table, batch_id)
        if old := {p: at for p, at in places.items() if p in touched}:
            now = upserted(_read(spark, table, old).drop("part"), batch, keys, order).drop("changed").withColumn("part", _part(keys, parts))
        else:
            now = new
        now.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/rows/batch={batch_id}")
        batch.unpersist()
        places |= dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(places.items()), "part int, at long").coalesce(1).write.mode("overwrite").parquet(f"{table}/places/batch={batch_id}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserts(spark: SparkSession, table: str) -> DataFrame:
    """The table that ``upsert_stream`` has made so far. It is an error to read one that no batch has written."""
    return _read(spark, table, _places(spark, table)).drop("part")


def _part(keys: list[str], parts: int):
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _places(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """Of each part the batch that wrote it last, by the newest list (earlier than that of the batch ``before``)."""
    if before == 0:
        return {}
    lists = spark.read.parquet(f"{table}/places")
    if before is not None:
        lists = lists.where(F.col("batch") < before)
    newest = lists.agg(F.max("batch").alias("batch"))
    return {r["part"]: r["at"] for r in lists.join(newest, "batch").collect()}


def _read(spark: SparkSession, table: str, places: dict[int, int]) -> DataFrame:
    by_batch: dict[int, list[int]] = {}
    for part, at in places.items():
        by_batch.setdefault(at, []).append(part)
    read = lambda at, some: spark.read.parquet(f"{table}/rows/batch={at}").where(F.col("part").isin(some))
    return reduce(DataFrame.unionByName, (read(at, some) for at, some in sorted(by_batch.items())))


def first_of_hash(records: DataFrame, hash_column: str, at: str, delay: str = "1 day") -> DataFrame:
    """The stream without rows whose hash was seen within the delay; state is bounded by the watermark."""
    return records.withWatermark(at, delay).dropDuplicatesWithinWatermark([hash_column])


def tumbling(events: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by type in tumbling (or sliding) windows; rows later than the delay are dropped by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Events of each user's sessions, which end where the gap passes without one."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))


def read_stream(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)
