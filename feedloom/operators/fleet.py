"""Runs of many sources side by side: each source is collected past its mark, stored, counted and told of in a table of runs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.ingest import run_status

#: Seconds that a source's Spark jobs may take.
CEILING = 300.0
COUNTS = "source string, run string, started_at timestamp, discovered long, stored long, failed long, mark timestamp, broke_off string, message string"

#: Collects a source: gets the session and the mark (None at first), gives items with external_id, record_type, at (timestamp) and error.
Collect = Callable[[SparkSession, datetime | None], DataFrame]


@dataclass
class _Run:
    source: str
    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    started_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    discovered: int = 0
    stored: int = 0
    failed: int = 0
    mark: datetime | None = None
    broke_off: str | None = None
    message: str | None = None


def judged(fetched: DataFrame) -> DataFrame:
    """fetched with ``broken``: null for a whole item, else what its error says or what it lacks; and ``collector``: whether the row is an error of the collector and no item."""
    lacks = F.when(F.coalesce("external_id", F.lit("")) == "", "missing_id").when(F.col("record_type").isNull(), "missing_type")
    return fetched.withColumn("collector", F.col("error").isNotNull()).withColumn("broken", F.coalesce("error", lacks))


def run_fleet(spark: SparkSession, sources: dict[str, Collect], folder: str, at_once: int = 4, ceiling: float = CEILING) -> DataFrame:
    """Runs every source and returns the rows that it adds to ``runs``, in no order.

    A source goes through once: its rows are written, whole ones apart from broken ones, and counted
    on the way (``observe``). Sources run side by side, each in a scheduler pool of its own name, which share alike where the
    session's scheduler is FAIR. One that raises, or whose jobs outlast ``ceiling`` seconds, is a failed run and doesn't touch the others.

    A run counts once its row is written, after its items; its mark is the latest time of what was stored, never
    before the former one, and stays where nothing was. A run that dies between leaves items that nobody reads and is collected
    again. An error that the collector tells of (a row with ``error``) counts as one failure, however many rows tell it; what came with it is stored.
    """
    before, context = marks(spark, folder), spark.sparkContext

    def one(source: str, collect: Collect) -> _Run:
        run = _Run(source, mark=before.get(source))
        context.setLocalProperty("spark.scheduler.pool", source)
        context.setJobGroup(run.run, source, interruptOnCancel=True)
        late = threading.Event()
        stop = threading.Timer(ceiling, lambda: (late.set(), context.cancelJobGroup(run.run)))
        stop.start()
        try:
            _collected(spark, run, collect, folder)
        except Exception as broke:  # whatever a source throws is its own failure
            run.discovered = run.stored = run.failed = 0
            run.mark = before.get(source)
            run.broke_off, run.message = ("TimeoutError" if late.is_set() else type(broke).__name__), str(broke)[:500]
        finally:
            stop.cancel()
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)
        # a folder for each run: writers of one folder would clear each other's unfinished files
        _told(spark, [run]).drop("run").write.parquet(f"{folder}/runs/run={run.run}")
        context.setLocalProperty("spark.scheduler.pool", None)
        return run

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        done = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), k, c) for k, c in sources.items()]]
    return _resolved(_told(spark, done))


def _collected(spark: SparkSession, run: _Run, collect: Collect, folder: str) -> None:
    seen = Observation(run.run)
    whole = F.col("broken").isNull()
    rows = judged(collect(spark, run.mark)).observe(
        seen,
        F.count_if(~F.col("collector")).alias("discovered"),
        F.count_if(whole).alias("stored"),
        F.count_if(~whole & ~F.col("collector")).alias("broken"),
        F.max(F.when(F.col("collector"), F.col("broken"))).alias("error"),
        F.max(F.when(whole, F.col("at"))).alias("mark"),
    )
    place = f"{folder}/items/{run.run}"
    rows.drop("collector", "error").withColumn("whole", whole).write.partitionBy("whole").parquet(place)
    counts = seen.get
    run.discovered, run.stored = counts.get("discovered", 0), counts.get("stored", 0)
    run.failed = counts.get("broken", 0) + (counts.get("error") is not None)
    run.mark = max((m for m in (run.mark, counts.get("mark")) if m is not None), default=None)
    if counts.get("error") is not None and not run.stored:
        run.broke_off = counts["error"]


def _told(spark: SparkSession, done: list[_Run]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in done], COUNTS).coalesce(1)


def _resolved(counts: DataFrame) -> DataFrame:
    status, code = run_status(F.col("stored"), F.col("failed"), F.col("broke_off"))
    return counts.select("source", "run", "started_at", status.alias("status"), code.alias("failure_code"), "discovered", "stored", "failed", "mark", "message")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run so far, with its status and counts; empty before the first."""
    try:
        found = spark.read.schema(COUNTS).parquet(f"{folder}/runs")
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], COUNTS)
    return _resolved(found)


def marks(spark: SparkSession, folder: str) -> dict[str, datetime]:
    """Each source's mark: one row for each source that is set up."""
    found = runs(spark, folder).where("mark is not null").groupBy("source").agg(F.max("mark").alias("mark"))
    return {r["source"]: r["mark"] for r in found.collect()}


def landed_items(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame | None:
    """The whole items (or the broken ones) of all runs that ended, with source and run; None where no run has stored any. Runs' items have like columns."""
    ended = runs(spark, folder).where(F.col("stored" if whole else "failed") > 0).where("failure_code is null or failure_code = 'ALL_ITEMS_FAILED'").select("source", "run").collect()
    parts = [spark.read.parquet(f"{folder}/items/{r['run']}").where(F.col("whole") == whole).withColumns({"source": F.lit(r["source"]), "run": F.lit(r["run"])}) for r in ended]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("whole") if parts else None
