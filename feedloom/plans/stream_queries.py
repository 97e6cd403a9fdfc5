"""Queries that run in steps: near-duplicates as a stream, and runs of a fleet of sources."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import fleet
from feedloom.plans.fixtures import NORMAL_SQL
from feedloom.plans.registry import query
from feedloom.sources.landing import REGISTRY
from feedloom.storage import shared_folder
from feedloom.streaming import near_stream

#: Files that one micro-batch of the stream takes in, and longer than the stream's times reach.
FILES, EVER = 8, timedelta(days=36500)


@query(
    f"with recursive {NORMAL_SQL},"
    + r""" s as (select record_id, connector, list_distinct(regexp_extract_all(lower(normalized), '[a-z0-9]+')) as t from normal where deleted_at is null and length(normalized) >= 20),
    alike as (select a.record_id as a, b.record_id as b, case when len(a.t) = 0 and len(b.t) = 0 then 1.0 else len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double end as similarity
      from s a join s b on a.connector is not distinct from b.connector and a.record_id < b.record_id and least(len(a.t), len(b.t)) >= 0.85 * greatest(len(a.t), len(b.t))),
    numbered as (select record_id, connector, row_number() over (partition by connector order by record_id) as n, coalesce((select list(a) from alike where b = record_id and similarity >= 0.85), []) as earlier from s),
    walk as (select distinct connector, 0::bigint as n, []::bigint[] as held, null::bigint as record_id, []::bigint[] as hits from numbered
      union all select w.connector, x.n, case when list_has_any(w.held, x.earlier) then w.held else list_append(w.held, x.record_id)[-500:] end, x.record_id, list_intersect(w.held, x.earlier)
      from walk w join numbered x on x.connector is not distinct from w.connector and x.n = w.n + 1),
    hits as (select connector, record_id, unnest(hits) as canonical_id from walk)
    select h.connector as scope, h.record_id, h.canonical_id, round(a.similarity, 6) as similarity from hits h join alike a on a.a = h.canonical_id and a.b = h.record_id
    qualify row_number() over (partition by h.record_id order by a.similarity desc, h.canonical_id desc) = 1"""
)
def dd03_near_stream(spark, sf_dir):
    """All documents as a stream in order of their files; equals its SQL where a table is one file, whose rows come in order of id."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a stream's path is a folder or a pattern
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/document[s].parquet")
    at = F.timestamp_seconds("doc_id")
    r = arriving.where("doc_id % 97 <> 0").select(F.col("doc_id").alias("record_id"), F.col("source").alias("connector"), text.normalized(F.col("text")).alias("normalized"), at.alias("at"))
    place, name = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, near_stream.PROVIDER)
    try:
        found = near_stream.near_duplicate_stream(r, "at", delay=f"{EVER.days} days", keep=EVER)
        found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(near_stream.OUT).parquet(f"{place}/out").withColumn("similarity", F.round("similarity", 6))


KEYS = [key for key, _, _ in REGISTRY]
#: What the collectors of the fourth and the fifth source tell of some and of all their rows; the last source raises.
ERROR = "case when doc_id % 9 = 3 and doc_id % 7 = 0 then 'rate_limited' when doc_id % 9 = 4 then 'auth' end"
_COUNTS = "count(*) filter (error is null) as discovered, count(*) filter (whole) as stored, count(*) filter (error is null and not whole) as broken, max(error) as error, max(doc_id) filter (whole) as mark"


@query(
    f"""with keys as (select generate_subscripts(k, 1) - 1 as s, unnest(k) as source from (select {KEYS!r} as k)),
    d as (select doc_id % 9 as s, doc_id, {ERROR} as error, {ERROR} is null and doc_id % 97 <> 0 and doc_id % 101 <> 0 as whole from documents where doc_id % 9 <> 8),
    one as (select s, {_COUNTS} from d where doc_id <= (select max(doc_id) // 2 from documents) group by s),
    two as (select s, {_COUNTS} from d left join (select s, mark as old from one) using (s) where old is null or doc_id > old group by s),
    runs as (select 1 as round, keys.*, one.* exclude (s) from keys left join one using (s)
      union all select 2, keys.*, two.* exclude (s) replace (greatest(two.mark, one.mark) as mark) from keys left join two using (s) left join one using (s)),
    counted as (select round, source, coalesce(discovered, 0) as discovered, coalesce(stored, 0) as stored, coalesce(broken, 0) + (error is not null)::int as failed, mark,
      case when s = 8 then 'RuntimeError' when coalesce(stored, 0) = 0 then error end as code from runs)
    select round, source, case when code is not null then 'failed' when failed > 0 and stored > 0 then 'partially_completed' when failed > 0 then 'failed' else 'completed' end as status,
      coalesce(code, case when failed > 0 and stored = 0 then 'ALL_ITEMS_FAILED' end) as failure_code, discovered, stored, failed, mark from counted"""
)
def ing12_fleet_runs(spark, sf_dir):
    """Two rounds of a fleet over all documents, dealt over the known sources: the first when half of them (by id) have come, the second past the marks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    half = docs.agg(F.max("doc_id")).first()[0]

    def collector(place: int, until: int | None):
        def collect(spark, mark):
            if place == 8:
                raise RuntimeError("not set up")
            i = F.col("doc_id")
            mine = docs.where(i % 9 == place) if until is None else docs.where((i % 9 == place) & (i <= until))
            rows = mine.select(
                F.when(i % 97 != 0, i.cast("string")).alias("external_id"), F.when(i % 101 != 0, REGISTRY[place][2]).alias("record_type"), F.col("text").alias("body"), F.timestamp_seconds(i).alias("at"), F.expr(ERROR).alias("error")
            )
            return rows if mark is None else rows.where(F.col("at") > F.lit(mark))

        return collect

    folder = f"{shared_folder(spark)}/fleet-{uuid.uuid4().hex}"
    rounds = [fleet.run_fleet(spark, {key: collector(n, until) for n, key in enumerate(KEYS)}, folder).withColumn("round", F.lit(n)) for n, until in ((1, None if half is None else half // 2), (2, None))]
    return rounds[0].union(rounds[1]).select("round", "source", "status", "failure_code", "discovered", "stored", "failed", F.unix_timestamp("mark").alias("mark"))
