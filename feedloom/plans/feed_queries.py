"""Queries over stored feeds: all documents as snapshots of their sources' feeds, read whole and as a stream with marks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.plans.fixtures import table
from feedloom.plans.registry import query
from feedloom.sources import feeds
from feedloom.storage import shared_folder

#: Ids that a snapshot reaches over; of each feed it has one snapshot for each such range.
REACH = 500
#: What XML can't hold.
_BAD = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]"
# whitespace within a line of HTML is one space; lines without text go
_BODY = rf"""nullif(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '{_BAD}', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\s\pZ\x{{85}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '')"""
_ENTRIES_SQL = f"""select coalesce(nullif(source, ''), 'none') as feed_url, lpad((doc_id // {REACH})::varchar, 12, '0') as snapshot, doc_id,
      'https://feeds.example/' || doc_id as source_url, 'entry ' || doc_id as title, {_BODY} as body,
      case when doc_id % 11 <> 0 then 1704067200 + 60 * (doc_id + doc_id * 37 % 1000) end as published
    from documents"""


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _element(name: str, content: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name}>")), F.lit(""))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, snapshot, value): the snapshots as XML, one a row; an entry for each document, every eleventh without a time."""
    i = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1704067200) + 60 * (i + i * 37 % 1000))
    published = F.when(i % 11 != 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
    text = F.regexp_replace("text", _BAD, " ")
    parts = (("title", F.concat(F.lit("entry "), i.cast("string"))), ("link", F.concat(F.lit("https://feeds.example/"), i.cast("string"))), ("description", _escaped(_escaped(text))), ("pubDate", published))
    entry = _element("item", F.concat(*(_element(n, c) for n, c in parts)))
    feed = F.coalesce(F.nullif("source", F.lit("")), F.lit("none"))
    told = table(spark, sf_dir, "documents").where("doc_id is not null").select(feed.alias("feed"), F.lpad(F.expr(f"doc_id div {REACH}").cast("string"), 12, "0").alias("snapshot"), entry.alias("entry"))
    return told.groupBy("feed", "snapshot").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("entry"), ""), F.lit("</channel></rss>")).alias("value"))


def _told(items: DataFrame) -> DataFrame:
    told = F.col("metadata")
    return items.select(told["feed_url"].alias("feed_url"), told["snapshot"].alias("snapshot"), "source_url", "title", "body", F.unix_timestamp("published_at").alias("published"))


@query(f"select * exclude (doc_id) from ({_ENTRIES_SQL})")
def src10_feed_items(spark, sf_dir):
    """The entries of all snapshots, read whole."""
    root = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    feeds.land(snapshots(spark, sf_dir), root)
    return _told(feeds.registered(spark).read.format("feeds").load(root))


@query(
    f"""with e as ({_ENTRIES_SQL}), s as (select feed_url, snapshot, max(published) as newest from e group by all),
    b as (select *, max(newest) over (partition by feed_url order by snapshot rows between unbounded preceding and 1 preceding) as bar from s)
    select e.* exclude (doc_id) from e join b using (feed_url, snapshot) where bar is null or published is null or published > bar"""
)
def src12_feed_stream(spark, sf_dir):
    """The fresh entries that two runs of the stream find: one when the snapshots of the lower half of the ids have landed, one past its marks."""
    place = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    root, out = f"{place}/feeds", f"{place}/out"
    rows = snapshots(spark, sf_dir)
    last = table(spark, sf_dir, "documents").agg(F.max(F.expr(f"doc_id div {REACH}"))).first()[0] or 0
    early = F.col("snapshot") <= str(last // 2).zfill(12)
    for part in (rows.where(early), rows.where(~early)):
        feeds.land(part, root)
        feeds.collected(spark, root, out).awaitTermination()
    schema = spark.read.format("feeds").load(root).schema
    return _told(spark.read.schema(schema).parquet(f"{out}/items/*"))
