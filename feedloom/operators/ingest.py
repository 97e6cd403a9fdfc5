"""Landing of raw items: serialisation, upserts, checkpoints, run status, artifact keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(*columns: str) -> Column:
    """SHA-256 of the row as JSON, its keys sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key. A maximum aggregate, which combines before the shuffle; nulls in ``order`` are oldest."""
    rest = [c for c in rows.columns if c not in keys]
    order_value = F.struct(F.col(order).isNotNull().alias("_known"), F.col(order).alias("_order"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_value).alias("_r")).select(*keys, "_r.*")


def upserted(current: DataFrame, arriving: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current with the newest arriving row of each key in place of a different one; ``changed`` tells the rows that are new or differ.

    Rows have a ``checksum``. One shuffle of either side, on the key.
    """
    new = latest(arriving, keys, order)
    rest = [c for c in current.columns if c not in keys]
    joined = current.alias("o").join(new.alias("n"), keys, "full_outer")
    changed = F.col("n.checksum").isNotNull() & ~F.col("o.checksum").eqNullSafe(F.col("n.checksum"))
    return joined.select(*keys, *(F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest), changed.alias("changed"))


def inserted_if_absent(dim: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    return dim.unionByName(arriving.dropDuplicates(keys).join(dim, keys, "left_anti"))


def run_status(stored: Column, failed: Column, failure_code: Column) -> tuple[Column, Column]:
    """(status, failure_code) of an ingestion run from its counts."""
    status = F.when(failure_code.isNotNull(), "failed").when((failed > 0) & (stored > 0), "partially_completed").when(failed > 0, "failed").otherwise("completed")
    return status, F.coalesce(failure_code, F.when((failed > 0) & (stored == 0), "ALL_ITEMS_FAILED"))


def artifact_key(source: Column, at: Column, run: Column, digest: Column, extension: str = "json") -> Column:
    return F.concat_ws("/", F.lit("raw"), source, F.date_format(at, "yyyy/MM/dd"), run, F.concat(digest, F.lit(f".{extension}")))


def unprocessed(raw: DataFrame, records: DataFrame, key: str, created: str, most: int | None = None) -> DataFrame:
    """Raw items without a record, oldest first; ``most`` of them at most."""
    left = raw.join(records.select(key), key, "left_anti").orderBy(created, key)
    return left if most is None else left.limit(most)


def with_media(metadata: Column, url: Column, kind: Column) -> Column:
    """The metadata map with the media's url and type where there is one."""
    return F.when(url.isNotNull(), F.map_concat(metadata, F.create_map(F.lit("media_url"), url, F.lit("media_type"), kind))).otherwise(metadata)


def write_artifacts(items: DataFrame, folder: str) -> None:
    """Items as JSON under source, day and run; columns source, year, month, day and run name the folders."""
    items.write.mode("append").partitionBy("source", "year", "month", "day", "run").json(folder)
