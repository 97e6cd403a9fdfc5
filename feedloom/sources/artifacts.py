"""Raw artifacts as files under content-addressed names: a Spark data source that writes them, and their check by reading back.

``items.write.format("artifacts").mode("append").save(root)`` takes source, run, captured_at, content and
optionally extension, and gives each item the file raw/source/yyyy/mm/dd/run/sha256.extension under ``root``,
a folder or URI of a file system with renames (local, network or HDFS) that driver and executors share.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from feedloom.operators.ingest import artifact_key

# The most bytes of an artifact, and of one of media.
MOST_BYTES, MOST_MEDIA_BYTES = 10_000_000, 50_000_000
STAGING = "_staging"
NEEDED = ("source", "run", "captured_at", "content")
PART = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]*")


class ArtifactError(ValueError):
    """An item that can't be written: empty, too large, or with a part of its name that could lead elsewhere."""


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged: its own folder, and how many files it wrote and found to be there already."""

    folder: str
    written: int
    known: int


def _bytes(content) -> bytes:
    return content.encode() if isinstance(content, str) else bytes(content)


class ArtifactWriter(DataSourceWriter):
    def __init__(self, root: str, most_bytes: int, columns: list[str]):
        if missing := [c for c in NEEDED if c not in columns]:
            raise ArtifactError(f"columns that are missing: {', '.join(missing)}")
        self.root, self.most_bytes, self.job = root, most_bytes, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def _key(self, row: Row, content: bytes) -> str:
        extension = (row["extension"] if "extension" in row.__fields__ else None) or "json"
        parts = (row["source"], row["run"], extension)
        if row["captured_at"] is None or not all(p and PART.fullmatch(p) for p in parts):
            raise ArtifactError(f"no name can be made of {parts} and {row['captured_at']}")
        if not 0 < len(content) <= self.most_bytes:
            raise ArtifactError(f"{len(content)} bytes, of 1 to {self.most_bytes}")
        return f"raw/{row['source']}/{row['captured_at']:%Y/%m/%d}/{row['run']}/{hashlib.sha256(content).hexdigest()}.{extension}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, base = self._open()
        mine = f"{base}/{STAGING}/{self.job}/{uuid.uuid4().hex}"  # an attempt that failed has another
        written, known, made = 0, 0, {posixpath.dirname(mine)}
        for row in iterator:
            content = _bytes(row["content"] or b"")
            key = self._key(row, content)
            done, mid = files.get_file_info([f"{base}/{key}", f"{mine}/{key}"])
            if mid.is_file or (done.is_file and done.size == len(content)):
                known += 1
                continue
            path = f"{mine}/{key}"
            self._make(files, posixpath.dirname(path), made)
            with files.open_output_stream(path) as out:
                out.write(content)
            with files.open_input_stream(path) as back:
                if back.read() != content:
                    raise OSError(f"{key} reads back differently")
            written += 1
        return Staged(mine, written, known)

    def _make(self, files: fs.FileSystem, folder: str, made: set[str]) -> None:
        """The folder, level by level below that of the job: where an abort has taken it away, a task that is still running fails and brings nothing back."""
        if folder not in made:
            self._make(files, posixpath.dirname(folder), made)
            files.create_dir(folder, recursive=False)
            made.add(folder)

    def open_job(self) -> None:
        files, base = self._open()
        files.create_dir(f"{base}/{STAGING}/{self.job}")

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves what the tasks staged to its place, a run's folder at once where it is new. Names are those of contents, so a commit that is cut off and repeated ends the same."""
        files, base = self._open()
        for staged in messages:
            if staged is not None and staged.written:
                self._move(files, staged.folder, base)
        self._clear(files, base)

    def _move(self, files: fs.FileSystem, at: str, to: str) -> None:
        files.create_dir(to)
        for entry in files.get_file_info(fs.FileSelector(at)):
            target = f"{to}/{entry.base_name}"
            there = files.get_file_info(target).type
            if entry.type == fs.FileType.Directory and there == fs.FileType.Directory:
                self._move(files, entry.path, target)
            else:
                files.move(entry.path, target)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._open())

    def _clear(self, files: fs.FileSystem, base: str) -> None:
        mine, staging = f"{base}/{STAGING}/{self.job}", f"{base}/{STAGING}"
        if files.get_file_info(mine).type == fs.FileType.Directory:
            files.move(mine, f"{mine}.gone")  # at once, so that tasks that are still running find it no more
            files.delete_dir(f"{mine}.gone")
        if files.get_file_info(staging).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(staging)):
            files.delete_dir(staging)


class Artifacts(DataSource):
    """The sink ``artifacts``. Options: path, and most_bytes, over which an item fails the job."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        if overwrite:
            raise ArtifactError("artifacts are added, never overwritten: use mode append")
        writer = ArtifactWriter(self.options["path"].rstrip("/"), int(self.options.get("most_bytes", MOST_BYTES)), schema.names)
        writer.open_job()
        return writer


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Artifacts)
    return spark


def described(items: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """items with storage_key, sha256, byte_size and problem: null, or why the sink would refuse the item (missing, empty, too_large).

    What the sink will write, worked out by columns alone: the key of a row needs no file.
    """
    content = F.col("content").cast("binary")
    size = F.octet_length(content)
    extension = F.col("extension") if "extension" in items.columns else F.lit(None).cast("string")
    digest = F.sha2(content, 256)
    missing = F.col("source").isNull() | F.col("run").isNull() | F.col("captured_at").isNull()
    named = artifact_key(F.col("source"), F.col("captured_at"), F.col("run"), digest, "")
    problem = F.when(missing, "missing").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most_bytes, "too_large")
    found = items.withColumn("storage_key", F.concat(named, F.coalesce(F.nullif(extension, F.lit("")), F.lit("json")))).withColumn("sha256", digest)
    return found.withColumn("byte_size", size.cast("long")).withColumn("problem", problem)


def verified(rows: DataFrame, root: str) -> DataFrame:
    """(storage_key, sha256, found): whether the file under ``root`` holds what the hash tells: ok, missing or differs. Files are read in the tasks, one at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = ArtifactWriter(root.rstrip("/"), 0, list(NEEDED))._open()
        for batch in batches:
            yield batch.assign(found=[_verdict(files, f"{base}/{k}", h) for k, h in zip(batch.storage_key, batch.sha256, strict=True)])

    return rows.select("storage_key", "sha256").mapInPandas(read, "storage_key string, sha256 string, found string")


def _verdict(files: fs.FileSystem, path: str, digest: str) -> str:
    if not files.get_file_info(path).is_file:
        return "missing"
    seen = hashlib.sha256()
    with files.open_input_stream(path) as content:
        while piece := content.read(1 << 20):
            seen.update(piece)
    return "ok" if seen.hexdigest() == digest else "differs"


def content_of(*columns: str) -> Column:
    """The item as JSON, its keys sorted: what is hashed and written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
