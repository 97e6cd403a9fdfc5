"""Queries over raw texts, records, duplicates and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import privacy, text
from feedloom.operators import grounding, ingest, quality
from feedloom.operators import records as rec
from feedloom.operators.retrieval import filtered
from feedloom.plans.fixtures import ELIGIBLE_SQL, KEYWORDS, LABELS_SQL, NORMAL_SQL, RAW_SQL, RECORDS_SQL, labels, raw, records, table
from feedloom.plans.registry import query
from feedloom.storage import tabled

WITH_RECORDS = f"with {RECORDS_SQL} "


@query(f"with {NORMAL_SQL} select record_id, normalized, sha256(normalized) as content_hash from normal")
def tx01_normalized(spark, sf_dir):
    n = text.normalized(F.col("text"))
    return raw(spark, sf_dir).select("record_id", n.alias("normalized")).withColumn("content_hash", text.content_hash(F.col("normalized")))


@query(r"select doc_id as record_id, (select string_agg(t, ' ' order by t) from (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t)) as tokens from documents")
def tx03_token_sets(spark, sf_dir):
    t = F.sort_array(text.tokens(F.col("text")))
    return raw(spark, sf_dir).select("record_id", F.when(F.size(t) > 0, F.array_join(t, " ")).alias("tokens"))


@query(
    r"""with s as (select doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents)
    select a.doc_id as record_id, case when len(a.t) = 0 and len(b.t) = 0 then 1.0 else round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double, 6) end as similarity
    from s a join s b on b.doc_id = a.doc_id + 1"""
)
def tx04_jaccard_with_next(spark, sf_dir):
    s = raw(spark, sf_dir).select("record_id", text.tokens(F.col("text")).alias("t"))
    after = s.select((F.col("record_id") - 1).alias("record_id"), F.col("t").alias("u"))
    return s.join(after, "record_id").select("record_id", F.round(text.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


@query(WITH_RECORDS + "select record_id, language_code, coalesce(is_mixed, false) as is_mixed, is_supported, relevance, quality, round(rating_value / rating_scale, 6) as rating from records")
def tx05_language_relevance_quality(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("record_id", F.col("language.code").alias("language_code"), F.col("language.mixed").alias("is_mixed"), F.col("language.supported").alias("is_supported"), "relevance", "quality", F.round(text.rating(F.col("rating_value"), F.col("rating_scale")), 6).alias("rating"))


@query()
def tx06_redactions(spark, sf_dir):
    return privacy.redaction_events(records(spark, sf_dir))


def _any_of(phrases):
    return "(" + " or ".join(f"contains(lower(text), '{p}')" for p in phrases) + ")"


#: Every document with one guarded phrase put before its text, each phrase in turn.
GUARDED = (*text.DEMOGRAPHIC, *text.CAUSAL, "nothing of the kind")
GUARDED_SQL = "guarded as (select record_id, [" + ", ".join(f"'{p}'" for p in GUARDED) + f"][(record_id % {len(GUARDED)} + 1)::int] || ' ' || text as text from raw)"


@query(
    f"with {RAW_SQL}, {GUARDED_SQL} select record_id, {_any_of(text.DEMOGRAPHIC)} as demographic, {_any_of(text.CAUSAL)} as causal, nullif(strpos(text, 'the') - 1, -1) as first_the, substr(text, 1, 240) as excerpt, "
    "case when (record_id % 100) / 100.0 >= 0.8 then 'high' when (record_id % 100) / 100.0 >= 0.55 then 'medium' else 'low' end as bucket from guarded"
)
def tx15_guards_and_offsets(spark, sf_dir):
    t = F.col("text")
    phrase = F.get(F.array(*map(F.lit, GUARDED)), (F.col("record_id") % len(GUARDED)).cast("int"))
    return raw(spark, sf_dir).withColumn("text", F.concat_ws(" ", phrase, "text")).select(
        "record_id", text.demographic(t).alias("demographic"), text.causal(t).alias("causal"), text.located(t, F.lit("the"))["start"].cast("long").alias("first_the"), text.excerpt(t, 240).alias("excerpt"), text.confidence_bucket((F.col("record_id") % 100) / 100.0).alias("bucket")
    )


@query("select doc_id as record_id, case when doc_id % 3 = 0 then text when text = '' then 'media' else text || E'\\n\\n[Extracted from media]\\nmedia' end as merged, '<untrusted>\n' || replace(replace(text, '<untrusted>', ''), '</untrusted>', '') || '\n</untrusted>' as delimited from documents")
def tx13_media_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    media = F.when(F.col("doc_id") % 3 != 0, "media")
    return d.select(F.col("doc_id").alias("record_id"), text.with_media_text(F.col("text"), media).alias("merged"), text.delimited(F.col("text")).alias("delimited"))


EXACT_SQL = """first as (select content_hash, min(record_id) as canonical_id, arg_min(connector, record_id) as first_connector from records where deleted_at is null group by content_hash),
exact as (select r.record_id, f.canonical_id, case when r.connector = f.first_connector then 'exact' else 'cross_source_repost' end as duplicate_type from records r join first f using (content_hash) where f.canonical_id < r.record_id)"""


@query(WITH_RECORDS + f", {EXACT_SQL} select * from exact")
def dd01_exact_duplicates(spark, sf_dir):
    return rec.exact_duplicates(records(spark, sf_dir))


@query(
    WITH_RECORDS
    + r""", s as (select record_id, list_sort(list_distinct(regexp_extract_all(lower(normalized), '[a-z0-9]+'))) as t from records where length(normalized) >= 20),
    c as (select t, min(record_id) as id from s group by t)
    select a.id as a, b.id as b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double, 6) as similarity
    from c a join c b on a.id < b.id and len(a.t) > 0 and len(b.t) > 0 and least(len(a.t), len(b.t)) >= 0.85 * greatest(len(a.t), len(b.t))
    where len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double >= 0.85"""
)
def dd03_similar_classes(spark, sf_dir):
    r = records(spark, sf_dir).where(F.length(text.stripped(F.col("normalized"))) >= rec.LEAST_NEAR)
    classes = tabled(rec.token_classes(r.select(F.lit(0).alias("scope"), "record_id", text.tokens(F.col("normalized")).alias("words"))))
    return rec.similar_classes(classes).select("a", "b", F.round("similarity", 6).alias("similarity"))


#: Links of duplicates; which records are primary follows record by record, in each connector.
LINKS_SQL = (
    f"with recursive {RECORDS_SQL}, {EXACT_SQL},"
    + r""" rest as (select record_id, connector, list_distinct(regexp_extract_all(lower(normalized), '[a-z0-9]+')) as t from records where deleted_at is null and length(normalized) >= 20 and record_id not in (select record_id from exact)),
    pairs as (select a.record_id as a, b.record_id as b, case when len(a.t) = 0 and len(b.t) = 0 then 1.0 else len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double end as similarity
      from rest a join rest b on a.connector = b.connector and a.record_id < b.record_id),
    alike as (select * from pairs where similarity >= 0.85),
    numbered as (select record_id, connector, row_number() over (partition by connector order by record_id) as n, coalesce((select list(a) from alike where b = record_id), []) as earlier from rest),
    walk as (select distinct connector, 0::bigint as n, []::bigint[] as primaries from numbered
      union all select w.connector, x.n, case when list_has_any(w.primaries, x.earlier) then w.primaries else list_append(w.primaries, x.record_id) end from walk w join numbered x on x.connector = w.connector and x.n = w.n + 1),
    chosen as (select distinct unnest(primaries) as a from walk),
    near as (select b as record_id, a as canonical_id, 'near' as duplicate_type, similarity from alike join chosen using (a) qualify row_number() over (partition by b order by similarity desc, a desc) = 1),
    links as (select record_id, canonical_id, duplicate_type, round(similarity, 6) as similarity, 'rule' as method, 1 as version from (select *, 1.0::double as similarity from exact union all select * from near)) """
)


@query(LINKS_SQL + "select * from links")
def dd05_duplicate_links(spark, sf_dir):
    return rec.duplicate_links(records(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(LINKS_SQL + "select count(*) as processed, count(*) filter (where record_id in (select record_id from links)) as duplicates, count(*) filter (where quality = 'malformed') as malformed from records")
def dd07_summary(spark, sf_dir):
    r = records(spark, sf_dir)
    return rec.summary(rec.with_primary(r, rec.duplicate_links(r)))


@query(WITH_RECORDS + f"select record_id from records where {ELIGIBLE_SQL}")
def fl01_eligible(spark, sf_dir):
    return rec.eligible(records(spark, sf_dir)).select("record_id")


@query(WITH_RECORDS + f"select record_id from records r where {ELIGIBLE_SQL} and not exists (select 1 from labels l where l.doc_id = r.record_id)")
def fl02_unclassified(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"))
    return rec.unclassified(records(spark, sf_dir), done).select("record_id")


@query(f"with {RAW_SQL} select record_id from raw where published_at >= timestamp '2024-02-01' and published_at <= timestamp '2024-03-01' and connector = (select min(source) from documents)")
def fl06_date_and_source_filters(spark, sf_dir):
    r = raw(spark, sf_dir)
    first = r.agg(F.min("connector")).first()[0]
    return filtered(r, {"date_from": "2024-02-01", "date_to": "2024-03-01", "source_connector_key": first}).select("record_id")


@query(f"with {RAW_SQL}, {LABELS_SQL} select record_id, dimension, label, round(confidence, 6) as confidence, nullif(spot - 1, -1)::int as start_offset, case when spot > 0 then (spot - 1 + length(word))::int end as end_offset from labels")
def cl01_persisted_labels(spark, sf_dir):
    taxonomy = spark.createDataFrame(list(KEYWORDS), "dimension string, label string")
    return grounding.persisted_labels(labels(spark, sf_dir), taxonomy).withColumn("confidence", F.round("confidence", 6))


@query(WITH_RECORDS + "select 'quality_domain' as rule, count(*) filter (quality not in ('usable', 'low_information', 'unsupported_language', 'malformed')) as violations from records union all select 'severity_range', count(*) filter (severity not between 0 and 4) from records union all select 'hash_length', count(*) filter (length(content_hash) <> 64) from records")
def dq01_constraints(spark, sf_dir):
    rules = {"quality_domain": quality.RECORD_RULES["quality_domain"], "severity_range": "severity is null or severity between 0 and 4", "hash_length": quality.RECORD_RULES["hash_length"]}
    return quality.violations(records(spark, sf_dir), rules)


@query(WITH_RECORDS + "select content_hash, count(*) as n from records group by content_hash having count(*) > 1")
def dq04_repeated_hashes(spark, sf_dir):
    return quality.repeated_keys(records(spark, sf_dir), ["content_hash"])


@query("select l.doc_id, l.quality, l.toxic from labels l where doc_id is not null and not exists (select 1 from embeddings e where e.vec_id = l.doc_id)")
def dq05_dangling_labels(spark, sf_dir):
    l, e = table(spark, sf_dir, "labels"), table(spark, sf_dir, "embeddings")
    return quality.dangling(l, "doc_id", e, "vec_id").select("doc_id", "quality", "toxic")


@query("select user_id, event_type, arg_max(event_id, ts) as event_id, round(max(value), 6) as top from events group by user_id, event_type")
def ing04_latest_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("top"))
    return ingest.latest(e.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts").drop("ts").join(top, ["user_id", "event_type"])


@query(
    """with o as (select doc_id as k, source as v, sha256(source) as checksum from documents where doc_id % 3 <> 0),
    n as (select doc_id as k, case when doc_id % 2 = 0 then source else source || 'x' end as v from documents where doc_id % 5 <> 0)
    select coalesce(o.k, n.k) as k, case when n.v is not null and (o.v is null or o.v <> n.v) then n.v else o.v end as v, n.v is not null and (o.v is null or o.v <> n.v) as changed from o full join n using (k)"""
)
def ing03_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("source").alias("v"))
    checked = lambda df: df.withColumn("checksum", F.sha2("v", 256)).withColumn("at", F.lit(1))
    new = d.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 2 == 0, F.col("v")).otherwise(F.concat("v", F.lit("x"))))
    return ingest.upserted(checked(d.where("k % 3 <> 0")), checked(new), ["k"], "at").select("k", "v", "changed")


@query(
    "select doc_id as run_id, case when doc_id % 7 = 0 then 'failed' when doc_id % 3 > 0 and doc_id % 4 > 0 then 'partially_completed' when doc_id % 3 > 0 then 'failed' else 'completed' end as status, case when doc_id % 7 = 0 then 'TIMEOUT' when doc_id % 3 > 0 and doc_id % 4 = 0 then 'ALL_ITEMS_FAILED' end as failure_code from documents"
)
def ing05_run_status(spark, sf_dir):
    i = F.col("doc_id")
    status, code = ingest.run_status(i % 4, i % 3, F.when(i % 7 == 0, "TIMEOUT"))
    return table(spark, sf_dir, "documents").select(i.alias("run_id"), status.alias("status"), code.alias("failure_code"))


@query(f"with {RAW_SQL} select record_id, 'raw/' || connector || '/' || strftime(timestamp '2024-01-01' + to_days((record_id % 365)::int), '%Y/%m/%d') || '/run1/' || sha256(text) || '.json' as key from raw")
def ing07_artifact_keys(spark, sf_dir):
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("record_id") % 365).cast("int"))
    return raw(spark, sf_dir).select("record_id", ingest.artifact_key(F.col("connector"), day, F.lit("run1"), F.sha2("text", 256)).alias("key"))


@query("select doc_id as record_id from documents where doc_id not in (select vec_id from embeddings)")
def ing11_unprocessed(spark, sf_dir):
    done = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"))
    return ingest.unprocessed(raw(spark, sf_dir).select("record_id"), done, "record_id", "record_id")


@query("with m as (select event_type, quantile_disc(event_id, 0.5) as mark from events group by event_type) select e.event_id, e.event_type from events e join m using (event_type) where e.event_id > m.mark")
def src12_past_high_water_mark(spark, sf_dir):
    from feedloom.sources.landing import past_mark

    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    marks = e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by event_id)").cast("long").alias("mark"))
    return past_mark(e, marks, "event_type", "event_id")


@query()
def tx11_page_text(spark, sf_dir):
    from feedloom.sources.web import items

    return items(table(spark, sf_dir, "pages"))


@query(
    r"""with l as (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) as h from pages),
    w as (select page_id, case when regexp_matches(h, '^https?://') then h when regexp_matches(h, '^/[^/]|^/$') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || h end as link from l)
    select distinct page_id, link from w where link is not null"""
)
def tx12_links(spark, sf_dir):
    from feedloom.sources.web import links

    return table(spark, sf_dir, "pages").select("page_id", F.explode(links(F.col("url"), F.col("html"))).alias("link"))


#: Hosts that are tried beside those of the pages, and whether each may be fetched.
HOSTS = {
    "10.0.0.1": False, "user@10.0.0.1": False, "user:pw@example.org": True, "[::1]": False, "[2001:4860:4860::8888]": False, "2130706433": False, "0x7f000001": False, "0177.0.0.1": False, "127.1": False,
    "8.8.8.8": True, "8.8.8.8:443": True, "172.15.0.1": True, "172.16.0.1": False, "172.31.255.255": False, "172.32.0.1": True, "169.254.169.254": False, "192.168.1.1": False, "100.64.0.1": False,
    "224.0.0.1": False, "255.255.255.255": False, "0.0.0.0": False, "localhost": False, "api.localhost": False, "EXAMPLE.org": True, "a.example.org.": True, "": False, "exa mple.org": False, "10.0.0.1.example.org": True,
}


@query(
    "with h as (select unnest([" + ", ".join(f"{{'h': '{h}', 'ok': {str(ok).lower()}}}" for h, ok in HOSTS.items()) + "]) as x), p as (select page_id, url from pages where url is not null) "
    "select scheme || '://' || x.h || '/a' as url, x.ok and scheme = 'https' as safe from h, (values ('https'), ('http'), ('ftp')) s(scheme) union all select url, starts_with(url, 'https://') from p"
)
def src14_safe_urls(spark, sf_dir):
    from feedloom.sources.web import safe

    tried = spark.createDataFrame([(f"{s}://{h}/a",) for s in ("https", "http", "ftp") for h in HOSTS], "url string")
    urls = tried.union(table(spark, sf_dir, "pages").where("url is not null").select("url"))
    return urls.select("url", safe(F.col("url")).alias("safe"))


@query(
    r"""with recursive l as (select distinct url, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) as h from pages),
    w as (select url, case when regexp_matches(h, '^https?://') then h when regexp_matches(h, '^/[^/]|^/$') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || h end as target from l),
    e as (select distinct w.url, w.target from w join (select distinct url from pages) p on p.url = w.target where regexp_extract(w.url, '^[a-z]+://([^/]*)', 1) = regexp_extract(w.target, '^[a-z]+://([^/]*)', 1)),
    seeds as (select min(url) as url from pages where url is not null group by regexp_extract(url, '^[a-z]+://([^/]*)', 1)),
    walk as (select url, 0 as depth from seeds union select e.target, walk.depth + 1 from walk join e using (url) where walk.depth < 2)
    select url, min(depth)::int as depth from walk group by url"""
)
def src11_crawl(spark, sf_dir):
    from feedloom.sources.web import crawl, host

    p = table(spark, sf_dir, "pages").select("url", "html")
    seeds = p.where("url is not null").groupBy(host(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    return crawl(p, seeds)


@query("select s as status, case when s in (401, 403) then 'auth' when s = 429 then 'rate_limited' when s between 500 and 599 then 'transient' when s >= 400 then 'unavailable' end as error, s = 429 or s between 500 and 599 as retryable from (select (200 + doc_id % 400)::bigint as s from documents)")
def src15_error_classes(spark, sf_dir):
    from feedloom.sources.landing import error_class

    s = table(spark, sf_dir, "documents").select((200 + F.col("doc_id") % 400).alias("status"))
    return s.withColumn("x", error_class(F.col("status"))).select("status", "x.*")


@query("select conv_id, turn, max(turn) over (partition by conv_id) as last_turn, turn - 1 as parent from conversations where turn > 0")
def dm_thread_relations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return c.where("turn > 0").join(last, "conv_id").withColumn("parent", F.col("turn") - 1)


