"""Queries over filters, search, embeddings, media, candidates, lineage, reviews, insights and details."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.operators import embedding, evaluation, grounding, insights, reads, retrieval, vector_index
from feedloom.operators import records as rec
from feedloom.operators import themes as th
from feedloom.plans.fixtures import ELIGIBLE_SQL, MEMBERS_SQL, RAW_SQL, RECORDS_SQL, memberships, raw, records, table
from feedloom.plans.registry import SQL, query
from feedloom.storage import shared_folder

def _id():
    return F.col("doc_id")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    """with a as (select doc_id, case doc_id % 6 when 0 then 'source_connector_key' when 1 then 'age' when 2 then 'date_from' when 3 then 'date_from' when 4 then 'taxonomy_label_key' else 'date_from' end as k,
      case doc_id % 6 when 0 then 'web' when 1 then 'x' when 2 then 'soon' when 3 then '2024-01-01' when 4 then 'Elderly people' else '2024-09-01' end as v from documents)
    select doc_id as question_id, case doc_id % 6 when 0 then 'source_connector_key=web' when 3 then 'date_from=2024-01-01,date_to=2024-05-01' when 1 then 'date_to=2024-05-01' when 2 then 'date_to=2024-05-01' when 4 then 'date_to=2024-05-01' else '' end || case when doc_id % 6 = 0 then ',date_to=2024-05-01' else '' end as filters,
      case doc_id % 6 when 1 then 'age: unsupported key' when 2 then 'date_from: no date' when 4 then 'taxonomy_label_key: demographic value' when 5 then 'date_from/date_to: inverted dates' else '' end as dropped from a"""
)
def fl04_checked_filters(spark, sf_dir):
    cases = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("source_connector_key", "web"), ("age", "x"), ("date_from", "soon"), ("date_from", "2024-01-01"), ("taxonomy_label_key", "Elderly people"), ("date_from", "2024-09-01"))))
    case = F.get(cases, (_id() % 6).cast("int"))
    asked = _docs(spark, sf_dir).select(_id().alias("question_id"), F.create_map(case["k"], case["v"], F.lit("date_to"), F.lit("2024-05-01")).alias("asked"))
    told = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    df = retrieval.checked_filters(asked)
    parts = F.col("filters")
    order = F.concat_ws(",", F.when(parts["source_connector_key"].isNotNull(), F.concat(F.lit("source_connector_key="), parts["source_connector_key"])), told(F.map_filter(parts, lambda k, v: k.startswith("date_"))))
    return df.select("question_id", order.alias("filters"), F.array_join("dropped", ",").alias("dropped"))


@query(
    """with v as (select vec_id, embedding::double[] as x from embeddings), s as (select q.vec_id as query_id, v.vec_id as record_id, round(list_cosine_similarity(v.x, q.x), 9) as similarity from v q join v on q.vec_id % 50 = 0),
    p as (select *, row_number() over (partition by query_id order by similarity desc, record_id) as place from s) select query_id, record_id, round(similarity, 6) as similarity from p where place <= 40"""
)
def wn09_nearest(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    asked = v.where("record_id % 50 = 0").withColumnRenamed("record_id", "query_id")
    return retrieval.nearest(v, asked).select("query_id", "record_id", F.round("similarity", 6).alias("similarity"))


@query(SQL["wn09_nearest"])
def vc05_index_search(spark, sf_dir):
    """The same by a stored index, built from half of the vectors, to which the other half is added."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(v.where("record_id % 2 = 0"), path)
    vector_index.add(v.where("record_id % 2 <> 0"), path)
    asked = v.where("record_id % 50 = 0").withColumnRenamed("record_id", "query_id")
    return vector_index.search(asked, path, exact=True).select("query_id", "record_id", F.round("similarity", 6).alias("similarity"))


@query(f"with {RECORDS_SQL} select record_id from records r where {ELIGIBLE_SQL} and not exists (select 1 from embeddings e where e.vec_id = r.record_id and e.vec_id % 2 = 0)")
def fl03_unembedded(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("configuration"), F.lit("feedback_record").alias("object_type"), F.col("vec_id").alias("object_id"))
    return embedding.unembedded(records(spark, sf_dir), e, "a").select("record_id")


@query("select vec_id as object_id, label || case when vec_id % 5 = 0 then 'x' else '' end as text_checksum from embeddings where vec_id % 2 = 0 and (vec_id % 3 = 0 or vec_id % 5 = 0)")
def vc02_new_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit("a").alias("configuration"), F.lit("feedback_record").alias("object_type"), F.col("vec_id").alias("object_id"), F.col("label").cast("string").alias("text_checksum"))
    arriving = e.where("object_id % 2 = 0").withColumn("text_checksum", F.when(F.col("object_id") % 5 == 0, F.concat("text_checksum", F.lit("x"))).otherwise(F.col("text_checksum")))
    return embedding.new_embeddings(e.where("object_id % 3 <> 0"), arriving.union(arriving)).select("object_id", "text_checksum")


@query(f"with {RAW_SQL} select record_id from raw where record_id % 3 = 0 and record_id % 9 <> 0 and deleted_at is null")
def tx14_pending_media(spark, sf_dir):
    r = raw(spark, sf_dir).withColumn("media_url", F.when(F.col("record_id") % 3 == 0, "u")).withColumn("extracted_media_text", F.when(F.col("record_id") % 9 == 0, ""))
    return rec.pending_media(r).select("record_id")


@query(
    """select doc_id % 20 as question_id, doc_id % 7 as object_id, arg_max(['candidate', 'reranked', 'selected'][(doc_id % 3 + 1)::int], doc_id) as stage, round(arg_max(doc_id * 0.5, doc_id) filter (doc_id % 4 <> 0), 6) as vector_score, max(doc_id) filter (doc_id % 5 = 0) as final_rank
    from documents group by all"""
)
def qa03_funnel(spark, sf_dir):
    none = F.lit(None).cast("double")
    steps = _docs(spark, sf_dir).select(
        (_id() % 20).alias("question_id"), F.lit("feedback_record").alias("object_type"), (_id() % 7).alias("object_id"), _id().alias("at"), F.get(F.array(*map(F.lit, ("candidate", "reranked", "selected"))), (_id() % 3).cast("int")).alias("stage"),
        F.when(_id() % 4 != 0, _id() * 0.5).alias("vector_score"), none.alias("keyword_score"), none.alias("structured_filter_score"), none.alias("rerank_score"), none.alias("diversity_penalty"), F.when(_id() % 5 == 0, _id()).alias("final_rank"), F.lit("r").alias("reason"),
    )
    return retrieval.funnel(steps).select("question_id", "object_id", "stage", F.round("vector_score", 6).alias("vector_score"), "final_rank")


@query(f"select q as question_id, '{grounding.NOT_ENOUGH}' as answer_text, 'passed_with_warnings' as grounding_status, 1 as warning_count from (select distinct doc_id % 50 as q from documents) where q % 4 = 0")
def qa06_unanswered(spark, sf_dir):
    q = _docs(spark, sf_dir).select((_id() % 50).alias("question_id")).distinct()
    return grounding.unanswered(q, q.where("question_id % 4 <> 0")).select("question_id", "answer_text", "grounding_status", "warning_count")


def _classified(spark, sf_dir):
    d = _docs(spark, sf_dir)
    analyses = d.select(_id().alias("analysis_id"), (_id() % 100).alias("record_id"), (_id() % 3).alias("version"), _id().alias("at"), (_id() % 2).alias("run_id"))
    labels = d.select(_id().alias("label_id"), (_id() - _id() % 2).alias("analysis_id"), F.lit("stage").alias("dimension"), (_id() % 2).alias("label_version"), (0.4 + (_id() % 6) / 10.0).alias("confidence"))
    return analyses, labels, d.where(_id() % 3 == 0).select(_id().alias("label_id"), F.substring("text", 1, 10).alias("excerpt"))


@query(
    """with n as (select doc_id % 100 as object_id, max(doc_id) as analysis_id from documents group by 1), i as (select distinct doc_id % 120 as object_id from documents),
    l as (select object_id, count(*) as labels, count(*) filter (d.doc_id % 2 = n.analysis_id % 3) as own, count(*) filter (d.doc_id % 3 = 0 and substr(d.text, 1, 10) <> '') as quoted from n join documents d on d.doc_id - d.doc_id % 2 = n.analysis_id group by 1)
    select i.object_id, n.analysis_id is null as missing, n.analysis_id, labels, own, quoted from i left join n using (object_id) left join l using (object_id)"""
)
def ev15_classification_candidates(spark, sf_dir):
    analyses, labels, spans = _classified(spark, sf_dir)
    items = _docs(spark, sf_dir).select((_id() % 120).alias("object_id")).distinct()
    c = evaluation.classification_candidates(items, analyses.select("record_id").distinct(), analyses, labels, spans)
    n = lambda f: F.when(F.col("labels").isNotNull(), F.size(F.filter("labels", f)).cast("long"))
    return c.select("object_id", "missing", "analysis_id", n(lambda x: F.lit(True)).alias("labels"), n(lambda x: x["own_version"]).alias("own"), n(lambda x: x["excerpt"] != "").alias("quoted"))


@query(
    f"""with {MEMBERS_SQL}, i as (select unnest(range(12)) as object_id), s as (select theme_id, count(*) as member_count, bool_or(is_representative) as has_representative, count(distinct connector) as sources from marked group by 1)
    select object_id, not (object_id < 9 and object_id <> 4) as missing, case when object_id < 9 and object_id <> 4 then coalesce(member_count, 0) end as member_count, case when object_id < 9 and object_id <> 4 then coalesce(has_representative, false) end as has_representative,
      case when object_id < 9 and object_id <> 4 then sources end as sources from i left join s on theme_id = object_id"""
)
def ev15_theme_candidates(spark, sf_dir):
    themes = spark.range(9).select(F.col("id").alias("theme_id"), F.lit("n").alias("name"), F.when(F.col("id") == 4, F.lit(1)).alias("deleted_at"))
    c = evaluation.theme_candidates(spark.range(12).withColumnRenamed("id", "object_id"), themes, th.ranked(memberships(spark, sf_dir)))
    return c.select("object_id", "missing", "member_count", "has_representative", F.when(F.col("source_counts").isNotNull(), F.size("source_counts").cast("long")).alias("sources"))


@query(
    """with c as (select distinct ['feedback_record', 'theme', 'insight', 'photo'][(doc_id % 4 + 1)::int] as object_type, doc_id % 130 as object_id from documents),
    n as (select doc_id % 100 as r, arg_max(doc_id % 2, doc_id) as run from documents group by 1)
    select object_type, object_id, case object_type when 'feedback_record' then r is not null when 'theme' then object_id < 20 when 'insight' then object_id < 40 else false end as known,
      case object_type when 'feedback_record' then r is not null and object_id % 7 = 0 when 'theme' then object_id < 20 and object_id % 3 = 0 else false end as deleted,
      case object_type when 'feedback_record' then run when 'theme' then case when object_id < 20 then object_id % 2 + 10 end when 'insight' then case when object_id < 40 then object_id % 2 + 20 end end as run_id from c left join n on object_type = 'feedback_record' and r = object_id"""
)
def ev16_citation_lineage(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("feedback_record", "theme", "insight", "photo")))
    cited = _docs(spark, sf_dir).select(F.get(kinds, (_id() % 4).cast("int")).alias("object_type"), (_id() % 130).alias("object_id"))
    analyses, *_ = _classified(spark, sf_dir)
    known = analyses.select("record_id", F.when(F.col("record_id") % 7 == 0, 1).alias("deleted_at")).distinct()
    some = lambda n, key, every: spark.range(n).select(F.col("id").alias(key), F.when(F.col("id") % every == 0, 1).alias("deleted_at"), (F.col("id") % 2).alias("set_id"))
    sets = lambda plus: spark.range(2).select(F.col("id").alias("set_id"), (F.col("id") + plus).alias("run_id"))
    return evaluation.citation_lineage(cited, known, analyses, some(20, "theme_id", 3), sets(10), some(40, "insight_id", 1000).withColumn("deleted_at", F.lit(None).cast("int")), sets(20))


@query(f"with {RAW_SQL} select r.record_id as label_id, round(0.4 + (r.record_id % 6) / 10.0, 6) as confidence, substr(text, 1, 240) as excerpt from raw r where r.record_id % 3 = 0 and r.record_id % 5 <> 4 order by 0.4 + (r.record_id % 6) / 10.0, label_id limit 25 offset 5")
def jn07_review_queue(spark, sf_dir):
    r = raw(spark, sf_dir).withColumn("redacted", F.col("text"))
    i = F.col("record_id")
    labels = r.select(i.alias("label_id"), i.alias("analysis_id"), F.lit("d").alias("dimension"), (i % 5).alias("label"), (0.4 + (i % 6) / 10.0).alias("confidence"), F.when(i % 3 == 0, "unreviewed").otherwise("approved").alias("review_status"))
    taxonomy = spark.range(4).select(F.lit("d").alias("dimension"), F.col("id").alias("label"), F.lit("L").alias("label_name"))
    dimensions = spark.range(1).select(F.lit("d").alias("dimension"), F.lit("D").alias("dimension_name"))
    q = evaluation.review_queue(labels, r.select(i.alias("analysis_id"), "record_id"), r, dimensions, taxonomy, offset=5)
    return q.select("label_id", F.round("confidence", 6).alias("confidence"), "excerpt")


@query(
    """with r as (select doc_id as run_id, ['classification', 'retrieval', 'theme', 'other'][(doc_id % 4 + 1)::int] as t from documents), n as (select t, max(run_id) as run_id from r group by 1)
    select k as evaluation_type, run_id from (select unnest(['classification', 'retrieval', 'theme', 'grounding']) as k) left join n on t = k"""
)
def rd08_latest_runs(spark, sf_dir):
    runs = _docs(spark, sf_dir).select(_id().alias("run_id"), (_id() % 4).alias("dataset_id"), F.lit("completed").alias("status"), _id().alias("at"))
    sets = spark.createDataFrame([(0, "classification"), (1, "retrieval"), (2, "theme"), (3, "other")], "dataset_id long, evaluation_type string")
    return evaluation.latest_run_by_type(runs, sets).select("evaluation_type", "run_id")


@query("select doc_id as item_id, doc_id % 4 in (0, 2) as accepted, doc_id % 4 in (0, 1) as blind_test from documents")
def ev20_dataset_items(spark, sf_dir):
    sets = spark.createDataFrame([(0, "draft", "blind_test"), (1, "locked", "blind_test"), (2, "draft", "dev")], "dataset_id long, status string, partition string")
    return evaluation.added_items(sets, _docs(spark, sf_dir).select(_id().alias("item_id"), (_id() % 4).alias("dataset_id"))).drop("dataset_id")


@query("select distinct case when doc_id % 2 = 0 then 'theme' else 'record' end as object_type, (doc_id % 300)::varchar as object_id from documents where (doc_id % 2 = 0 and doc_id % 300 >= 9) or (doc_id % 2 = 1 and not exists (select 1 from embeddings where vec_id = doc_id % 300))")
def jn14_unresolved(spark, sf_dir):
    refs = _docs(spark, sf_dir).select(F.when(_id() % 2 == 0, "theme").otherwise("record").alias("object_type"), (_id() % 300).alias("object_id")).distinct()
    return evaluation.unresolved(refs, theme=spark.range(9), record=table(spark, sf_dir, "embeddings").select("vec_id"))


@query("select doc_id as set_id, case when doc_id % 5 = 0 then 'rejected' when doc_id % 3 > 0 or doc_id % 5 < 4 then 'draft' else 'ready_for_review' end as status from documents")
def ag22_insight_set_status(spark, sf_dir):
    return _docs(spark, sf_dir).select(_id().alias("set_id"), insights.set_status(F.lit(4), _id() % 5, _id() % 3).alias("status"))


@query("with s as (select doc_id as insight_id, doc_id % 10 as set_id, case when doc_id % 3 <> 0 then doc_id * 0.5 end as score from documents where doc_id % 8 <> 0) select insight_id, round(score, 6) as opportunity_score from s where set_id = 9")
def rd05_insight_list(spark, sf_dir):
    all_ = _docs(spark, sf_dir).select(_id().alias("insight_id"), (_id() % 10).alias("set_id"), F.when(_id() % 3 != 0, _id() * 0.5).alias("opportunity_score"), F.when(_id() % 8 == 0, 1).alias("deleted_at"))
    return reads.insight_list(all_, spark.range(10).select(F.col("id").alias("set_id"), F.col("id").alias("at"))).select("insight_id", F.round("opportunity_score", 6).alias("opportunity_score"))


@query(f"with {RECORDS_SQL} select record_id, connector as source_name, substr(normalized, 1, 240) as excerpt, text as original_text, normalized as redacted_text, language_code from records where record_id = 97")
def rd03_evidence_detail(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("redacted", F.col("normalized"))
    names = r.select("connector", F.col("connector").alias("display")).distinct()
    return reads.evidence_detail(r, names, 97).drop("published_at")


@query(
    """with l as (select doc_id // 5 as question_id, ['created', 'planning', 'retrieving', 'generating', 'answered'][(doc_id % 5 + 1)::int] as step, timestamp '2024-01-01' + to_minutes(doc_id) as ts,
      case when doc_id % 41 = 0 then 'ModelError' end as failure_code, case doc_id % 3 when 0 then 'passed' when 1 then 'passed_with_warnings' else 'failed' end as grounding from documents where doc_id % 7 <> 0),
    q as (select question_id, bool_or(failure_code is not null) as failed, arg_min(failure_code, ts) filter (failure_code is not null) as failure_code, min(ts) filter (failure_code is not null) as failed_at,
      min(ts) filter (step = 'planning') as started_at, max(ts) filter (step = 'answered') as answered_at, arg_max(grounding, ts) filter (step = 'answered') as grounding, arg_max(step, ts) as furthest from l group by question_id)
    select question_id, case when failed then 'failed' when answered_at is null then furthest when grounding = 'passed' then 'completed' else 'completed_with_warnings' end as status,
      started_at, case when failed then failed_at else answered_at end as completed_at, failure_code from q"""
)
def qa07_question_states(spark, sf_dir):
    log = _docs(spark, sf_dir).where("doc_id % 7 != 0").select(
        F.floor(_id() / 5).alias("question_id"),
        F.get(F.array(*map(F.lit, grounding.STEPS)), (_id() % 5).cast("int")).alias("step"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(doc_id as int))").alias("at"),
        F.when(_id() % 41 == 0, "ModelError").alias("failure_code"),
        F.get(F.array(F.lit("passed"), F.lit("passed_with_warnings"), F.lit("failed")), (_id() % 3).cast("int")).alias("grounding_status"),
    )
    return grounding.question_states(log)
