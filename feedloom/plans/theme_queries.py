"""Queries over themes, retrieval, grounding, evaluation and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import clustering, evaluation, grounding, hierarchy, reads, retrieval
from feedloom.operators import records as rec
from feedloom.operators import themes as th
from feedloom.plans.fixtures import AS_OF, LABELS_SQL, MEMBERS_SQL, RAW_SQL, RECORDS_SQL, THEMES_SQL, labels, memberships, raw, records, table, themes, vectors
from feedloom.plans.registry import query
from feedloom.storage import stored

WITH_MEMBERS = f"with {MEMBERS_SQL} "
SUPPORT_SQL = f"""with {MEMBERS_SQL}, {THEMES_SQL},
eligible as (select count(*)::double as n, count(distinct source)::double as connectors from documents),
base as (select theme_id, count(*) as record_count, count(distinct connector) as source_breadth, count(*) filter (published_at >= timestamp '{AS_OF}' - interval 90 days) / count(*)::double as recency_share,
  avg(membership_score) as coherence, bool_or(is_counterexample) as ce from marked group by theme_id),
grades as (select m.theme_id, avg(r.severity) as s from marked m join raw r using (record_id) group by m.theme_id),
scored as (select t.theme_id, t.name, coalesce(record_count, 0) as record_count, coalesce(record_count, 0) / e.n as record_share, coalesce(source_breadth, 0) as source_breadth, coalesce(recency_share, 0) as recency_share, coherence,
  100 * (0.25 * least(greatest(coalesce(record_count, 0) / e.n, 0), 1) + 0.20 * least(coalesce(s, 2.0) / 5, 1) + 0.10 * coalesce(recency_share, 0) + 0.15 * least(coalesce(source_breadth, 0) / greatest(1, e.connectors), 1) + 0.10 * confidence
   + 0.10 * case when theme_type in ('repeat_category_driver', 'exploration_barrier', 'discovery_mechanism', 'habit_signal', 'experimentation_signal', 'unmet_need', 'information_need') then 0.9 else 0.5 end
   + 0.10 * least(greatest(0.5 + case when ce then 0.2 else 0 end + 0.2 * coalesce(coherence, 0), 0), 1)) as opportunity_score
  from themes t cross join eligible e left join base b using (theme_id) left join grades g using (theme_id)) """


def _marked(spark, sf_dir):
    return th.ranked(memberships(spark, sf_dir))


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.countDistinct("source").alias("c")).first()
    return th.metrics(_marked(spark, sf_dir), themes(spark), raw(spark, sf_dir).select("record_id", "severity"), docs["n"], docs["c"], AS_OF)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(WITH_MEMBERS + "select theme_id, record_id, rank::int as rank, is_representative, is_counterexample from marked")
def wn01_theme_ranks(spark, sf_dir):
    return _marked(spark, sf_dir).select("theme_id", "record_id", "rank", "is_representative", "is_counterexample")


@query(SUPPORT_SQL + "select theme_id, record_count, round(record_share, 6) as record_share, source_breadth, round(recency_share, 6) as recency_share, round(coherence, 6) as coherence, round(opportunity_score, 6) as opportunity_score from scored")
def ag13_theme_metrics(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return _rounded(s.select("theme_id", "record_count", "record_share", "source_breadth", "recency_share", "coherence", "opportunity_score"), "record_share", "recency_share", "coherence", "opportunity_score")


@query(
    SUPPORT_SQL
    + """select theme_id, metric_key, round(numeric_value, 6) as numeric_value, null::varchar as json_value from (select theme_id, unnest(['record_count', 'record_share', 'source_breadth', 'coherence_score', 'opportunity_score']) as metric_key,
      unnest([record_count::double, record_share, source_breadth::double, coherence, opportunity_score]) as numeric_value from scored) where numeric_value is not null
    union all select theme_id, 'source_distribution', null, '{' || coalesce(string_agg('"' || connector || '":null', ',' order by connector), '') || '}' from themes left join (select distinct theme_id, connector from members) using (theme_id) group by theme_id"""
)
def ag14_metric_rows(spark, sf_dir):
    return _rounded(th.metric_rows(_scored(spark, sf_dir), memberships(spark, sf_dir)), "numeric_value")


@query(WITH_MEMBERS + "select theme_id, connector, count(*) as records from members group by all")
def ag04_source_counts(spark, sf_dir):
    return th.source_counts(memberships(spark, sf_dir))


@query(WITH_MEMBERS + ", c as (select theme_id, connector, count(*) as n from members group by all) select theme_id, round(max(n) / sum(n)::double, 6) as top_share, max(n) / sum(n)::double < 0.9 as passed from c group by theme_id")
def ag21_source_concentration(spark, sf_dir):
    return _rounded(th.concentration(memberships(spark, sf_dir)), "top_share")


OVERLAP_SQL = """, m as (select theme_id, record_id from members union select (theme_id + 1) % 9, record_id from members where record_id % 3 = 0),
sizes as (select theme_id, count(*) as n from m group by 1), pairs as (select a.theme_id as a, b.theme_id as b, a.n as na, b.n as nb, (select count(*) from m x join m y using (record_id) where x.theme_id = a.theme_id and y.theme_id = b.theme_id) as common from sizes a join sizes b on a.theme_id < b.theme_id),
per as (select record_id, count(*) as k from m group by 1)
select round((select count(*) from per) / 1000.0::double, 6) as coverage, round(50 / 1000.0::double, 6) as outlier_rate, round((select avg(common / (na + nb - common)::double) from pairs), 6) as mean_overlap, round((select count(*) filter (k > 1) / count(*)::double from per), 6) as multi_theme_share"""


@query(WITH_MEMBERS + OVERLAP_SQL)
def ag15_set_quality(spark, sf_dir):
    m = memberships(spark, sf_dir).select("theme_id", "record_id")
    more = m.where("record_id % 3 = 0").select(((F.col("theme_id") + 1) % 9).alias("theme_id"), "record_id")
    return _rounded(th.set_quality(m.union(more).distinct(), 1000, 50), "coverage", "outlier_rate", "mean_overlap", "multi_theme_share")


@query(WITH_MEMBERS + f", {LABELS_SQL}, c as (select theme_id, dimension, label, count(distinct record_id) as records from members join labels using (record_id) group by all) select *, row_number() over (partition by theme_id order by records desc, dimension, label)::int as place from c")
def ag03_theme_tags(spark, sf_dir):
    return th.tags(memberships(spark, sf_dir), labels(spark, sf_dir).select("record_id", "dimension", "label"))


@query(WITH_MEMBERS + "select count(distinct record_id) as clustered, 7::bigint as outliers, count(distinct theme_id) as themes, case when count(*) = 0 then 'rejected' else 'ready_for_review' end as status from members")
def vc08_set_counters(spark, sf_dir):
    return th.set_counters(memberships(spark, sf_dir), 7)


CENTROID_SQL = """with e as (select vec_id as record_id, label::bigint as theme_id, embedding::double[] as v from embeddings),
d as (select theme_id, i, avg(v[i]) as m from (select theme_id, v, unnest(range(1, len(v) + 1)) as i from e) group by all),
n as (select theme_id, sqrt(sum(m * m)) + 1e-9 as norm from d group by 1),
c as (select theme_id, list(m / norm order by i) as c from d join n using (theme_id) group by 1)
select record_id, theme_id, round(least(greatest(list_dot_product(v, c), 0), 1), 6) as membership_score from e join c using (theme_id)"""


@query(CENTROID_SQL)
def vc07_membership_scores(spark, sf_dir):
    return _rounded(th.memberships(vectors(spark, sf_dir)).select("record_id", "theme_id", "membership_score"), "membership_score")


@query()
def vc06_density_clusters(spark, sf_dir):
    return clustering.clustered(vectors(spark, sf_dir).select("record_id", "embedding"))


@query()
def vc06_theme_hierarchy(spark, sf_dir):
    return hierarchy.clustered(vectors(spark, sf_dir).select("record_id", "embedding"))


QUERY_SQL = "q as (select embedding::double[] as q from embeddings where vec_id = 0)"


def _query_vector(spark, sf_dir):
    asked = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()
    if asked is None:
        raise ValueError("the question's vector (vec_id 0) isn't there")
    return list(asked["embedding"])


@query(f"with {QUERY_SQL} select vec_id as record_id, round(greatest(0, list_cosine_similarity(embedding::double[], q)), 6) as similarity from embeddings, q")
def vc04_cosine(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.round(F.greatest(F.lit(0.0), retrieval.cosine(F.col("embedding"), q)), 6).alias("similarity"))


CANDIDATES_SQL = f"""with {RECORDS_SQL}, {QUERY_SQL},
near as (select r.record_id, r.connector, normalized, greatest(0, list_cosine_similarity(e.embedding::double[], q.q)) as similarity from records r join embeddings e on e.vec_id = r.record_id, q
  where quality in ('usable', 'low_information') and relevance not in ('insufficient_content', 'spam_or_promotion') and deleted_at is null order by similarity desc, record_id limit 40),
words as (select *, list_filter(regexp_split_to_array(lower(normalized), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from near),
found as (select *, case when list_contains(w, 'the') then len(list_filter(w, lambda x: x = 'the')) / len(w)::double else 0.0 end as keyword from words),
scored as (select *, 0.6 * similarity + 0.4 * case when (max(keyword) over ()) = (min(keyword) over ()) then 1.0 else (keyword - min(keyword) over ()) / (max(keyword) over () - min(keyword) over ()) end as score from found)"""


def _candidates(spark, sf_dir):
    r = rec.eligible(records(spark, sf_dir)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding"), "record_id")
    return stored(retrieval.candidates(r.select("record_id", "connector", F.col("normalized").alias("redacted"), "embedding"), _query_vector(spark, sf_dir), "the"))  # 40 rows, which selection reads several times


@query(CANDIDATES_SQL + " select record_id, connector, round(similarity, 6) as similarity, round(keyword, 6) as keyword, round(score, 6) as score from scored")
def vc10_hybrid_candidates(spark, sf_dir):
    none = spark.createDataFrame([], "record_id long")
    return _rounded(retrieval.selected(_candidates(spark, sf_dir), none).select("record_id", "connector", "similarity", "keyword", "score"), "similarity", "keyword", "score")


@query(
    CANDIDATES_SQL
    + """, s as (select *, row_number() over (partition by connector order by score desc, record_id) as k from scored),
    p as (select *, k <= 2 as fits, row_number() over (partition by k <= 2 order by score desc, record_id) as place from s),
    m as (select *, fits and place <= 12 as chosen, record_id % 5 = 0 as ce from p),
    f as (select *, not (select bool_or(chosen and ce) from m) and ce and not chosen and row_number() over (partition by ce and not chosen order by score desc, record_id) = 1 as forced from m),
    t as (select *, coalesce(count(*) filter (fits) over (order by score desc, record_id rows between unbounded preceding and 1 preceding), 0) as taken from f),
    u as (select *, case when chosen or forced then 'selected' else 'excluded' end as stage from t)
    select record_id, stage, forced, case when stage = 'excluded' then case when taken >= 12 then 'context_size_cap' else 'source_concentration_cap' end end as reason,
      case when stage = 'selected' then 'E' || row_number() over (partition by stage order by forced, score desc, record_id) end as label from u"""
)
def wn05_selected_evidence(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    ce = c.where("record_id % 5 = 0").select("record_id")
    return retrieval.selected(c, ce, per_source=2).select("record_id", "stage", "forced", "reason", "label")


@query(SUPPORT_SQL + "select theme_id, 'T' || row_number() over (order by opportunity_score desc nulls last, theme_id) as label from scored order by opportunity_score desc nulls last, theme_id limit 3")
def wn08_top_themes(spark, sf_dir):
    return retrieval.top(_scored(spark, sf_dir).select("theme_id", "opportunity_score"), "theme_id", "T").select("theme_id", "label")


@query()
def qa02_evidence_package(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    t = retrieval.top(scored.select("theme_id", "name", "opportunity_score"), "theme_id", "T")
    i = retrieval.top(scored.select((F.col("theme_id") + 100).alias("insight_id"), F.concat(F.lit("insight on "), "name").alias("title"), "opportunity_score"), "insight_id", "I")
    ce = _marked(spark, sf_dir).where("is_counterexample").join(t.select("theme_id"), "theme_id", "left_semi").select("record_id")
    return retrieval.package(t, i, retrieval.selected(_candidates(spark, sf_dir), ce))


FINDINGS_SQL = """f as (select doc_id as finding_id, doc_id % 50 as answer_id, case when doc_id % 11 = 0 then 'elderly buyers' when doc_id % 7 = 0 then 'delay leads to loss' else 'plain' end as statement, doc_id % 4 as k, doc_id % 5 = 0 as stray from documents),
v as (select *, case when contains(statement, 'elderly') then true else false end as redacted, contains(statement, 'leads to') as causal, k as resolved, case when stray then 1 else 0 end as dropped from f)"""


def _findings(spark, sf_dir):
    i = F.col("doc_id")
    known = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, (i % 4).cast("int")), lambda x: F.concat(F.lit("E"), x))
    cited = F.concat(known, F.when(i % 5 == 0, F.array(F.lit("E99"))).otherwise(F.array().cast("array<string>")))
    statement = F.when(i % 11 == 0, "elderly buyers").when(i % 7 == 0, "delay leads to loss").otherwise("plain")
    package = spark.createDataFrame([(f"E{n}", "feedback_record", str(n), n == 3) for n in (1, 2, 3)], "label string, object_type string, object_id string, is_counterexample boolean")
    return table(spark, sf_dir, "documents").select(i.alias("finding_id"), (i % 50).alias("answer_id"), statement.alias("statement"), cited.alias("labels")), package


@query(f"with {FINDINGS_SQL} select finding_id, resolved, dropped::bigint as dropped, redacted, case when redacted or resolved = 0 then 'unsupported' else 'supported' end as support_status, array_to_string(list_filter([case when dropped > 0 then 'unresolvable_citation:warning' end, case when redacted then 'possible_demographic_inference:error' end, case when causal and not redacted then 'causal_overclaim:warning' end, case when not redacted and resolved = 0 then 'insufficient_evidence:warning' end], lambda w: w is not null), ',') as warnings from v")
def qa04_validated_findings(spark, sf_dir):
    v = grounding.validated(*_findings(spark, sf_dir))
    return v.select("finding_id", "resolved", F.col("dropped").cast("long").alias("dropped"), "redacted", "support_status", F.array_join("warnings", ",").alias("warnings"))


@query(
    f"""with {FINDINGS_SQL}, w as (select *, case when redacted then 1 else 0 end + case when causal and not redacted then 1 else 0 end + dropped + case when not redacted and resolved = 0 then 1 else 0 end as nw from v)
    select answer_id, count(*) as findings, count(*) filter (not redacted and resolved > 0) as kept, sum(nw)::bigint as warnings,
    case when bool_or(redacted) or (count(*) filter (not redacted and resolved > 0) = 0 and bool_or(resolved + dropped > 0)) then 'failed' when sum(nw) > 0 then 'passed_with_warnings' else 'passed' end as grounding_status from w group by answer_id"""
)
def qa05_answer_status(spark, sf_dir):
    return grounding.answer_status(grounding.validated(*_findings(spark, sf_dir)))


@query(f"with {FINDINGS_SQL} select finding_id, 'E' || x as label, case when x = 3 then 'contradictory' else 'supporting' end as role from (select finding_id, unnest(range(1, k + 1)) as x from v)")
def jn13_resolved_citations(spark, sf_dir):
    return grounding.resolved_citations(*_findings(spark, sf_dir)).select("finding_id", "label", "role")


@query(
    """with i as (select doc_id as insight_id, ['synthesized_insight', 'product_hypothesis', 'theme_summary'][(doc_id % 3 + 1)::int] as kind, doc_id % 4 <> 0 as link, doc_id % 5 as support, case when doc_id % 2 = 0 then 'try it' end as rec, case when doc_id % 6 <> 0 then 1.5 end as score, doc_id % 7 <> 0 as comp from documents)
    select insight_id, array_to_string(list_filter([case when not link and support <= 0 then 'INS-001' end, case when kind = 'synthesized_insight' and support = 0 then 'INS-001' end, case when kind = 'product_hypothesis' and rec is null then 'INS-010' end, case when score is not null and not comp then 'INS-015' end], lambda x: x is not null), ',') as violated from i"""
)
def in01_publishability(spark, sf_dir):
    i = F.col("doc_id")
    kinds = F.array(F.lit("synthesized_insight"), F.lit("product_hypothesis"), F.lit("theme_summary"))
    df = table(spark, sf_dir, "documents").select(
        i.alias("insight_id"), F.get(kinds, (i % 3).cast("int")).alias("insight_type"), (i % 4 != 0).alias("has_theme_link"), (i % 5).alias("support_count"), F.when(i % 2 == 0, "try it").alias("recommendation"), F.when(i % 6 != 0, 1.5).alias("opportunity_score"), (i % 7 != 0).alias("has_components")
    )
    return grounding.publishability(df).select("insight_id", F.array_join("violated", ",").alias("violated"))


def _citations(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select((i % 40).alias("object_id"), F.lit("record").alias("cited_type"), (i % 60).alias("cited_id"), (i % 2).alias("run_id"), (i % 97 == 0).alias("deleted"))


CITED_SQL = "c as (select doc_id % 40 as object_id, doc_id % 60 as cited_id, doc_id % 2 as run_id, doc_id % 97 = 0 as deleted from documents)"
GRADED_SQL = f"""with {CITED_SQL}, {MEMBERS_SQL}, {LABELS_SQL},
g as (select object_id, 'cross_version_contamination' as grader, count(distinct run_id) <= 1 as passed, null::double as score, count(distinct run_id) > 1 as hard_failure from c group by 1
union all select object_id, 'deleted_object_retrieval', not bool_or(deleted), null, bool_or(deleted) from c group by 1
union all select object_id, 'duplicate_evidence', (count(*) - count(distinct cited_id)) / count(*)::double < 0.05, 1 - (count(*) - count(distinct cited_id)) / count(*)::double, false from c group by 1
union all select theme_id, 'representative_evidence', bool_or(is_representative), null, not bool_or(is_representative) from marked group by 1
union all select record_id, 'low_confidence_rate', true, avg(case when confidence < 0.5 then 1.0 else 0.0 end), false from labels group by 1
union all select doc_id, 'insufficient_evidence_policy', doc_id % 3 > 0 or contains(lower(text), 'not enough'), null, not (doc_id % 3 > 0 or contains(lower(text), 'not enough')) from documents
union all select doc_id, 'causal_overclaim', not (contains(lower(text), 'leads to') or contains(lower(text), 'led to') or contains(lower(text), 'causes') or contains(lower(text), 'causing')), null, false from documents) """


def _graded(spark, sf_dir):
    c = _citations(spark, sf_dir)
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.col("text").alias("answer"), (F.col("doc_id") % 3).alias("citation_count"))
    parts = [
        evaluation.cross_version_contamination(c),
        evaluation.deleted_object_retrieval(c),
        evaluation.duplicate_evidence(c),
        evaluation.representative_evidence(_marked(spark, sf_dir)),
        evaluation.low_confidence_rate(labels(spark, sf_dir).withColumnRenamed("record_id", "object_id")),
        evaluation.insufficient_evidence_policy(answers),
        evaluation.causal_overclaim(answers, ["answer"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(GRADED_SQL + "select object_id, grader, passed, round(score, 6) as score, hard_failure from g")
def ev09_graded_candidates(spark, sf_dir):
    return _rounded(_graded(spark, sf_dir), "score")


@query(
    GRADED_SQL
    + """, n as (select grader, avg(passed::int) as a, sum(hard_failure::int)::double as h, avg(score) as m, count(*) as n, count(score) as s from g group by 1)
    select grader || '_pass_rate' as metric_key, round(a, 6) as numeric_value, n as sample_size from n union all select grader || '_hard_failure_count', h, n from n union all select grader || '_mean_score', round(m, 6), s from n where m is not null"""
)
def ag16_run_metrics(spark, sf_dir):
    return _rounded(evaluation.run_metrics(_graded(spark, sf_dir)), "numeric_value")


@query(
    GRADED_SQL
    + """, bad as (select distinct grader from g where hard_failure or (not passed and grader in ('insufficient_evidence_policy', 'cross_version_contamination', 'deleted_object_retrieval', 'representative_evidence')))
    select case when count(*) > 0 then 'fail' when (select avg(passed::int) from g where grader = 'causal_overclaim') < 0.9 or (select avg(passed::int) from g where grader = 'duplicate_evidence') < 0.95 then 'pass_with_conditions' else 'pass' end as status,
    string_agg(grader, ',' order by grader) as failures from bad"""
)
def ev17_release_gate(spark, sf_dir):
    gate = evaluation.release_gate(evaluation.run_metrics(_graded(spark, sf_dir)))
    failures = F.when(F.size("zero_tolerance_failures") > 0, F.array_join(F.array_sort("zero_tolerance_failures"), ","))
    return gate.select("status", failures.alias("failures"))


@query(
    """with a as (select doc_id % 100 as item_id, doc_id as annotation_id, doc_id // 100 as round, doc_id % 3 = 0 as adjudicated, source as value from documents)
    select item_id, arg_max(value, round * 1000000 + annotation_id) as value from a where adjudicated group by item_id"""
)
def ev19_gold_annotations(spark, sf_dir):
    i = F.col("doc_id")
    a = table(spark, sf_dir, "documents").select((i % 100).alias("item_id"), i.alias("annotation_id"), F.floor(i / 100).alias("round"), (i % 3 == 0).alias("adjudicated"), F.col("source").alias("value"))
    return evaluation.gold_annotations(a)


@query(
    """with p as (select quality::varchar as gold, toxic::varchar as predicted from labels), l as (select gold as label from p union select predicted from p),
    n as (select label, (select count(*) from p where gold = label) as support, (select count(*) from p where predicted = label) as found, (select count(*) from p where predicted = label and gold = label) as tp from l)
    select label, round(case when found > 0 then tp / found::double else 0 end, 6) as precision, round(case when support > 0 then tp / support::double else 0 end, 6) as recall, round(case when tp > 0 then 2.0 * tp / (found + support) else 0 end, 6) as f1, support from n"""
)
def ev_classification_report(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("predicted"))
    return _rounded(evaluation.classification_report(p), "precision", "recall", "f1")


@query(
    f"with {RECORDS_SQL}, h as (select * from records where deleted_at is null and normalized ilike '%the%' order by published_at desc nulls last, record_id limit 20 offset 10) select record_id, connector as source_name, published_at::date as published_on, substr(normalized, 1, 240) as excerpt from h"
)
def rd01_evidence_page(spark, sf_dir):
    connectors = table(spark, sf_dir, "documents").select(F.col("source").alias("connector"), F.col("source").alias("display")).distinct()
    page, _ = reads.evidence_page(records(spark, sf_dir).withColumn("redacted", F.col("normalized")), connectors, search="the", offset=10)
    return page.select("record_id", "source_name", F.col("published_at").cast("date").alias("published_on"), "excerpt")


@query(f"with {RAW_SQL} select distinct connector from raw where deleted_at is null")
def rd02_source_facet(spark, sf_dir):
    connectors = table(spark, sf_dir, "documents").select(F.col("source").alias("connector")).distinct()
    return reads.source_facet(raw(spark, sf_dir), connectors)


@query(SUPPORT_SQL + "select theme_id, name, round(opportunity_score, 6) as opportunity_score from scored")
def rd04_theme_list(spark, sf_dir):
    return _rounded(reads_themes(spark, sf_dir).select("theme_id", "name", "opportunity_score"), "opportunity_score")


def reads_themes(spark, sf_dir):
    return th.theme_list(_scored(spark, sf_dir))


@query("select * from (select 'ingestion' as run_type, event_id as run_id, ts as started_at from events where event_type = 'error' union all select 'analysis', event_id, ts from events where event_type = 'click') order by started_at desc, run_type, run_id limit 50")
def rd06_run_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = lambda kind, name: e.where(F.col("event_type") == kind).select(F.lit(name).alias("run_type"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    return reads.run_feed(part("error", "ingestion"), part("click", "analysis"))


@query("select doc_id % 10 as report_id, max(doc_id % 7) + 1 as next_number from documents group by 1")
def ag20_next_position(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("report_id"), (F.col("doc_id") % 7).alias("position"))
    return reads.next_number(d, ["report_id"], "position")


@query(f"with {RAW_SQL} select count(*) as total, count(distinct connector) as connectors from raw where deleted_at is null")
def ag02_overview(spark, sf_dir):
    return raw(spark, sf_dir).where("deleted_at is null").agg(F.count("*").alias("total"), F.countDistinct("connector").alias("connectors"))
