"""Queries over the landing of items: hashes, checksums, metadata, new rows of a dimension, marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import ingest
from feedloom.plans.fixtures import table
from feedloom.plans.registry import query
from feedloom.sources.landing import new_marks


@query("select doc_id as record_id, case when doc_id % 7 <> 0 and source <> '' then sha256(source) end as author_hash from documents")
def src09_author_hash(spark, sf_dir):
    name = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), text.author_hash(name).alias("author_hash"))


@query("""select doc_id as record_id, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce(to_json(lang)::varchar, 'null') || ',"source":' || coalesce(to_json(source)::varchar, 'null') || '}') as checksum from documents""")
def ing02_checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), ingest.checksum("source", "doc_id", "lang").alias("checksum"))


@query("select source, lang, bool_or(doc_id % 5 = 0) as known from documents group by source, lang")
def ing06_get_or_create(spark, sf_dir):
    """Pairs of source and language: those of every fifth document are known before, the others come with all documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    known = d.where("doc_id % 5 = 0").select("source", "lang", F.lit(True).alias("known")).distinct()
    return ingest.inserted_if_absent(known, d.select("source", "lang", F.lit(False).alias("known")), ["source", "lang"])


@query(
    """select doc_id as record_id, case when doc_id % 3 = 0 then 'lang' else 'lang,media_type,media_url' end as keys, case when doc_id % 3 <> 0 then 'https://media.example/' || doc_id end as media_url,
    case when doc_id % 3 <> 0 then case when doc_id % 2 = 0 then 'image' else 'video' end end as media_type, lang from documents"""
)
def ing10_media_metadata(spark, sf_dir):
    i = F.col("doc_id")
    url = F.when(i % 3 != 0, F.concat(F.lit("https://media.example/"), i.cast("string")))
    m = ingest.with_media(F.create_map(F.lit("lang"), F.col("lang")), url, F.when(i % 2 == 0, "image").otherwise("video"))
    told = table(spark, sf_dir, "documents").select(i.alias("record_id"), m.alias("m"))
    return told.select("record_id", F.array_join(F.sort_array(F.map_keys("m")), ",").alias("keys"), *(F.col("m")[k].alias(k) for k in ("media_url", "media_type", "lang")))


@query(
    """with seen as (select event_type, min(event_id) as low, max(event_id) as high from events group by event_type)
    select event_type, case when event_type = (select min(event_type) from seen) or length(event_type) % 2 = 0 then high else high + 5 end as mark from seen union all select 'silent', 7"""
)
def src12_new_marks(spark, sf_dir):
    """Feeds with an older mark, with one that is newer than their entries, with none, and one without entries."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    seen = e.groupBy("event_type").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    first = seen.agg(F.min("event_type").alias("event_type"))
    old = F.when(F.length("event_type") % 2 == 0, F.col("low")).otherwise(F.col("high") + 5)
    marks = seen.join(first, "event_type", "left_anti").select("event_type", old.alias("mark"))
    silent = spark.range(1).select(F.lit("silent").alias("event_type"), F.lit(7).cast("long").alias("mark"))
    return new_marks(e, marks.union(silent), "event_type", "event_id")
