"""Stored feeds as a Spark data source: snapshots of RSS and Atom feeds read as raw items, whole or as a stream.

``spark.read.format("feeds").load(root)`` and ``spark.readStream.format("feeds").load(root)`` give the columns of
``landing.ITEM``. Under ``root``, a folder or URI that driver and executors share, a snapshot is
``feed=<name, percent-encoded>/snapshot=<name>/<file>``; the names of a feed's snapshots sort as they were taken.
Tasks read the files; the driver lists their names.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from feedloom.sources.landing import ITEM
from feedloom.sources.web import page

#: Files that one task reads.
FILES = 32
COLUMNS = [field.strip().split(" ", 1)[0] for field in ITEM.split(", ")]
ENTRIES = {"item", "entry"}


@dataclass(frozen=True)
class Stored:
    feed: str
    snapshot: str
    path: str


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
    return files, base.rstrip("/")


def snapshots(root: str) -> list[Stored]:
    """The files under ``root``, by feed and snapshot; hidden ones, and what a writer has begun and not committed, are left out."""
    files, base = _opened(root)
    found = []
    for info in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        parts = info.path.removeprefix(base).strip("/").split("/")
        if info.is_file and len(parts) == 3 and parts[0].startswith("feed=") and parts[1].startswith("snapshot=") and parts[2][0] not in "._":
            found.append(Stored(unquote(parts[0].removeprefix("feed=")), unquote(parts[1].removeprefix("snapshot=")), info.path))
    return sorted(found, key=lambda s: (s.feed, s.snapshot, s.path))


def land(rows: DataFrame, root: str) -> None:
    """Stores snapshots (feed, snapshot, value: the XML), none null, under ``root``, one file each, from the tasks that have them.

    A file is written under a hidden name and moved to its own, which its content gives, so readers see whole files and a
    task that is repeated writes the same ones. The driver moves nothing, as a committer by partitions would.
    """

    def store(some: Iterator[Row]) -> None:
        files, base = _opened(root)
        for r in some:
            folder = f"{base}/feed={quote(r['feed'], safe='')}/snapshot={quote(r['snapshot'], safe='')}"
            content = r["value"].encode()
            name = f"{hashlib.sha256(content).hexdigest()}.xml"
            begun = f"{folder}/.{name}-{uuid.uuid4().hex}"
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(begun) as out:
                out.write(content)
            files.move(begun, f"{folder}/{name}")

    rows.select("feed", "snapshot", "value").foreachPartition(store)


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def when(told: str | None) -> datetime | None:
    """A time of RFC 822 or ISO 8601; without a zone it is UTC. Null for anything else."""
    if not told or not told.strip():
        return None
    for read in (parsedate_to_datetime, datetime.fromisoformat):
        try:
            at = read(told.strip())
            return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
        except (ValueError, TypeError, OverflowError):
            continue
    return None


def _told(entry: ET.Element) -> dict[str, str]:
    """The first text that isn't blank of each of an entry's elements; of links the one to the entry itself."""
    told: dict[str, str] = {}
    for part in entry:
        name, text = _local(part.tag), "".join(part.itertext()).strip()
        if name == "link" and part.get("href") and part.get("rel", "alternate") == "alternate":
            text = part.get("href").strip()
        if text:
            told.setdefault(name, text)
    return told


def entries(content: bytes, feed: str, snapshot: str) -> Iterator[dict]:
    """The items of a feed's snapshot, as dicts of ITEM's columns. Entries without a link fall out; of a broken feed those before the break stay."""
    try:
        for _, element in ET.iterparse(io.BytesIO(content), events=("end",)):
            if _local(element.tag) not in ENTRIES:
                continue
            told = _told(element)
            element.clear()
            if link := told.get("link"):
                author = told.get("author") or told.get("creator")
                metadata = {"feed_url": feed, "author_display_name": author, "snapshot": snapshot}
                times = (when(told.get(k)) for k in ("pubdate", "published", "date", "updated"))
                yield {
                    "external_id": hashlib.sha256(link.encode()).hexdigest(),
                    "record_type": "article_passage",
                    "body": page(told.get("summary") or told.get("description"))["body"],
                    "source_url": link,
                    "published_at": next((at for at in times if at), None),
                    "title": told.get("title"),
                    "metadata": {k: v for k, v in metadata.items() if v},
                }
    except ET.ParseError:
        return


@dataclass
class Files(InputPartition):
    files: list[Stored]


class _Reading:
    """What reading whole and as a stream share."""

    def __init__(self, root: str):
        self.root = root

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _opened(self.root)
        for stored in partition.files:
            with files.open_input_stream(stored.path) as content:
                whole = content.read()
            for item in entries(whole, stored.feed, stored.snapshot):
                yield tuple(item.get(c) for c in COLUMNS)

    def _dealt(self, found: list[Stored]) -> list[Files]:
        return [Files(found[i : i + FILES]) for i in range(0, len(found), FILES)]


class FeedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self._dealt(snapshots(self.root)) or [Files([])]


class FeedStreamReader(_Reading, DataSourceStreamReader):
    """The offset is each feed's newest snapshot. A snapshot whose name sorts before one that was read is not read any more."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s.feed: s.snapshot for s in snapshots(self.root)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self._dealt([s for s in snapshots(self.root) if start.get(s.feed, "") < s.snapshot <= end.get(s.feed, "")])


class Feeds(DataSource):
    """The source ``feeds``. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options["path"])

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Feeds)
    return spark


def fresh(items: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, marks): the items that are newer than their feed's mark or have no time, and each feed's mark after them.

    items are those of ``feeds``, marks (feed, mark) one row for each feed. Snapshots count one after another: what a snapshot
    tells raises the mark for the next ones of its feed. Items meet one row for each snapshot, so a hot feed is split like any
    large join side; only its snapshots' times go to one task.
    """
    known = items.withColumn("_feed", F.col("metadata")["feed_url"]).withColumn("_snapshot", F.col("metadata")["snapshot"])
    newest = known.groupBy("_feed", "_snapshot").agg(F.max("published_at").alias("_newest"))
    before = Window.partitionBy("_feed").orderBy("_snapshot").rowsBetween(Window.unboundedPreceding, -1)
    bars = newest.join(marks.select(F.col("feed").alias("_feed"), "mark"), "_feed", "left")
    bars = bars.withColumn("_bar", F.greatest("mark", F.max("_newest").over(before)))
    past = F.col("_bar").isNull() | F.col("published_at").isNull() | (F.col("published_at") > F.col("_bar"))
    kept = known.join(bars.select("_feed", "_snapshot", "_bar"), ["_feed", "_snapshot"]).where(past).select(*items.columns)
    seen = newest.groupBy(F.col("_feed").alias("feed")).agg(F.max("_newest").alias("_seen"))
    return kept, marks.join(seen, "feed", "full_outer").select("feed", F.greatest("mark", "_seen").alias("mark"))


def _empty_marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "feed string, mark timestamp")


def marks_of(spark: SparkSession, folder: str) -> DataFrame:
    """The marks that ``collected`` has stored last under ``folder``; none before its first batch."""
    files, base = _opened(folder)
    done = [i.path for i in files.get_file_info(fs.FileSelector(f"{base}/marks", recursive=True, allow_not_found=True)) if i.base_name == "_SUCCESS"]
    newest = max((int(posixpath.basename(posixpath.dirname(p))) for p in done), default=None)
    return _empty_marks(spark) if newest is None else spark.read.parquet(f"{folder}/marks/{newest}")


def collected(spark: SparkSession, root: str, folder: str) -> StreamingQuery:
    """A run over the snapshots that came since the last one: fresh items under ``folder``/items, a folder for each batch, and the marks after each.

    A batch that is repeated after a failure reads the marks of the batch before it and writes its own folders anew, so nothing
    is lost or doubled. It ends when all that is stored has been read.
    """

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        marks = session.read.parquet(f"{folder}/marks/{number - 1}") if number else _empty_marks(session)
        batch = batch.persist()
        try:
            kept, after = fresh(batch, marks)
            kept.write.mode("overwrite").parquet(f"{folder}/items/batch={number}")
            after.write.mode("overwrite").parquet(f"{folder}/marks/{number}")
        finally:
            batch.unpersist()

    arriving = registered(spark).readStream.format("feeds").load(root)
    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
