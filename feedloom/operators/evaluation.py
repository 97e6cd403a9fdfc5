"""Graders, run metrics, release gates, annotations and reviews.

A grader takes a DataFrame with one candidate a row and gives (object_id, grader, passed, score, hard_failure).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import causal, demographic

# What a release may never fail in, and the bounds of the other metrics.
ZERO_TOLERANCE = ("citation_integrity", "demographic_inference", "insufficient_evidence_policy", "unsupported_label", "classification_demographic_inference", "cross_version_contamination", "deleted_object_retrieval", "representative_evidence", "theme_naming_integrity")
BOUNDS = {"schema_integrity_pass_rate": (1.0, None), "citation_integrity_mean_score": (0.95, None), "causal_overclaim_pass_rate": (0.90, None), "duplicate_evidence_pass_rate": (0.95, None)}
LOW_CONFIDENCE, MOST_REPEATS = 0.5, 0.05


def graded(df: DataFrame, grader: str, passed: Column, score: Column | None = None, hard: bool = False) -> DataFrame:
    score = F.lit(None).cast("double") if score is None else score.cast("double")
    return df.select("object_id", F.lit(grader).alias("grader"), passed.alias("passed"), score.alias("score"), (~passed if hard else F.lit(False)).alias("hard_failure"))


def schema_integrity(df: DataFrame, required: list[str]) -> DataFrame:
    missing = F.size(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in required))))
    return graded(df, "schema_integrity", missing == 0, hard=True)


def citation_integrity(answers: DataFrame, known: DataFrame) -> DataFrame:
    """answers (object_id, findings: array<array<string>> of cited ids, citation_count) against known (cited_id). Unknown ids fail hard; a wrong count fails softly."""
    spread = answers.select("object_id", F.posexplode("findings").alias("finding", "ids")).select("object_id", "finding", F.explode("ids").alias("cited_id"))
    marked = spread.join(known.select("cited_id").distinct().withColumn("_known", F.lit(True)), "cited_id", "left")
    n = marked.groupBy("object_id").agg(F.count_if(F.col("_known").isNull()).alias("fabricated"), F.count("*").alias("cited"), F.countDistinct("finding").alias("covered"))
    df = answers.join(n, "object_id", "left").na.fill(0, ["fabricated", "cited", "covered"])
    passed = (F.col("fabricated") == 0) & (F.col("cited") == F.col("citation_count"))
    score = F.when(F.size("findings") == 0, 1.0).otherwise(F.col("covered") / F.size("findings"))
    return df.select("object_id", F.lit("citation_integrity").alias("grader"), passed.alias("passed"), score.cast("double").alias("score"), (F.col("fabricated") > 0).alias("hard_failure"))


def text_guard(df: DataFrame, grader: str, texts: list[str], guard, hard: bool) -> DataFrame:
    bad = reduce(lambda a, b: a | b, (guard(F.col(c)) for c in texts))
    return graded(df, grader, ~bad, hard=hard)


def demographic_inference(df: DataFrame, texts: list[str]) -> DataFrame:
    return text_guard(df, "demographic_inference", texts, demographic, True)


def causal_overclaim(df: DataFrame, texts: list[str]) -> DataFrame:
    return text_guard(df, "causal_overclaim", texts, causal, False)


def theme_naming_integrity(themes: DataFrame) -> DataFrame:
    joined = themes.withColumn("_t", F.concat_ws(" ", "name", "summary"))
    return text_guard(joined, "theme_naming_integrity", ["_t"], causal, True)


def insufficient_evidence_policy(df: DataFrame) -> DataFrame:
    """An answer without citations has to say that there was not enough."""
    return graded(df, "insufficient_evidence_policy", (F.col("citation_count") > 0) | F.coalesce(F.lower("answer").contains("not enough"), F.lit(False)), hard=True)


def unsupported_label(labels: DataFrame) -> DataFrame:
    """labels (object_id, label_version, analysis_version)."""
    n = labels.groupBy("object_id").agg(F.bool_and(F.col("label_version") == F.col("analysis_version")).alias("same"))
    return graded(n, "unsupported_label", F.col("same"), hard=True)


def classification_demographic_inference(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("object_id").agg(F.bool_or(demographic(F.col("excerpt"))).alias("bad"))
    return graded(n, "classification_demographic_inference", ~F.col("bad"), hard=True)


def low_confidence_rate(labels: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    """Informational: always passes; the score is null without labels."""
    n = labels.groupBy("object_id").agg(F.avg(F.when(F.col("confidence").isNotNull(), (F.col("confidence") < below).cast("int"))).alias("rate"))
    return graded(n, "low_confidence_rate", F.lit(True), F.col("rate"))


def cross_version_contamination(citations: DataFrame) -> DataFrame:
    n = citations.groupBy("object_id").agg(F.countDistinct("run_id").alias("runs"))
    return graded(n, "cross_version_contamination", F.col("runs") <= 1, hard=True)


def deleted_object_retrieval(citations: DataFrame) -> DataFrame:
    n = citations.groupBy("object_id").agg(F.bool_or("deleted").alias("bad"))
    return graded(n, "deleted_object_retrieval", ~F.col("bad"), hard=True)


def duplicate_evidence(citations: DataFrame, most: float = MOST_REPEATS) -> DataFrame:
    """Share of citations that repeat one of the same answer. Two aggregates, no window over an answer's citations."""
    n = citations.groupBy("object_id", "cited_type", "cited_id").agg(F.count("*").alias("n")).groupBy("object_id").agg(((F.sum("n") - F.count("*")) / F.sum("n")).alias("rate"))
    return graded(n, "duplicate_evidence", F.col("rate") < most, 1 - F.col("rate"))


def representative_evidence(members: DataFrame) -> DataFrame:
    n = members.groupBy(F.col("theme_id").alias("object_id")).agg(F.bool_or("is_representative").alias("some"))
    return graded(n, "representative_evidence", F.col("some"), hard=True)


def source_concentration(shares: DataFrame) -> DataFrame:
    return graded(shares.withColumnRenamed("theme_id", "object_id"), "source_concentration", F.col("passed"), 1 - F.col("top_share"))


def run_metrics(results: DataFrame) -> DataFrame:
    """(metric_key, numeric_value, sample_size): pass rate, hard failures and mean score of each grader; the mean has its own n."""
    n = results.groupBy("grader").agg(F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.sum(F.col("hard_failure").cast("int")).cast("double").alias("hard_failure_count"), F.avg("score").alias("mean_score"), F.count("*").alias("n"), F.count("score").alias("scored"))
    rows = F.array(*(F.struct(F.concat("grader", F.lit(f"_{k}")).alias("metric_key"), F.col(k).alias("numeric_value"), F.col(s).alias("sample_size")) for k, s in (("pass_rate", "n"), ("hard_failure_count", "n"), ("mean_score", "scored"))))
    return n.select(F.inline(rows)).where("numeric_value is not null")


def run_status(evaluated: Column, failed: Column) -> Column:
    return F.when(evaluated == 0, "failed").when(failed > 0, "completed_with_warnings").otherwise("completed")


def analysis_status(done: Column, failed: Column) -> Column:
    return F.when((done > 0) & (failed > 0), "partially_completed").when((done == 0) & (failed > 0), "failed").otherwise("completed")


def release_gate(metrics: DataFrame, zero: tuple[str, ...] = ZERO_TOLERANCE, bounds: dict = BOUNDS) -> DataFrame:
    """One row: status, zero_tolerance_failures, metric_failures. metrics: (metric_key, numeric_value), those without a dimension; missing ones are skipped."""
    value = lambda k: F.max(F.when(F.col("metric_key") == k, F.col("numeric_value"))).alias(k)
    keys = [f"{z}{s}" for z in zero for s in ("_hard_failure_count", "_pass_rate")] + list(bounds)
    one = metrics.where(F.col("metric_key").isin(*dict.fromkeys(keys))).agg(*map(value, dict.fromkeys(keys)))
    hard = F.array_compact(F.array(*(F.when((F.col(f"{z}_hard_failure_count") > 0) | (F.col(f"{z}_pass_rate") < 1.0), z) for z in zero)))
    off = F.array_compact(F.array(*(F.when((F.col(k) < lo if lo is not None else F.lit(False)) | (F.col(k) > hi if hi is not None else F.lit(False)), k) for k, (lo, hi) in bounds.items())))
    df = one.select(hard.alias("zero_tolerance_failures"), off.alias("metric_failures"))
    return df.withColumn("status", F.when(F.size("zero_tolerance_failures") > 0, "fail").when(F.size("metric_failures") > 0, "pass_with_conditions").otherwise("pass"))


def gold_annotations(annotations: DataFrame) -> DataFrame:
    """(item_id, value): of each item the adjudicated annotation of the last round; items without one are left out."""
    return annotations.where("adjudicated").groupBy("item_id").agg(F.max_by("value", F.struct("round", "annotation_id")).alias("value"))


def gold_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejected lines) of gold JSON lines; a data set with a rejected line must not be loaded."""
    schema = "object_type string, object_id string, input_snapshot map<string,string>, gold_output map<string,string>, notes string"
    df = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema).alias("x")).select("value", "x.*")
    uuid = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    good = F.coalesce(F.col("object_type").isin("research_answer", "feedback_analysis", "theme") & F.col("object_id").rlike(uuid) & F.col("input_snapshot").isNotNull() & F.col("gold_output").isNotNull(), F.lit(False))
    return df.where(good).drop("value"), df.where(~good).select("value")


def applied_reviews(labels: DataFrame, decisions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """labels (label_id, label) with the latest valid decision (label_id, at, decision, reason, new_label).

    Rejections and second reviews need a reason; an edit's label must be in the taxonomy (label).
    """
    known = taxonomy.select(F.col("label").alias("new_label")).distinct().withColumn("_known", F.lit(True))
    df = decisions.join(known, "new_label", "left")
    reasoned = F.coalesce(F.col("reason") != "", F.lit(False))
    valid = (~F.col("decision").isin("reject", "second_review") | reasoned) & ((F.col("decision") != "edit") | F.coalesce("_known", F.lit(False)))
    last = df.where(valid).groupBy("label_id").agg(F.max_by(F.struct("decision", "new_label"), "at").alias("d"))
    status = {"approve": "approved", "reject": "rejected", "edit": "edited", "second_review": "needs_second_review"}
    mapped = F.element_at(F.create_map(*(F.lit(x) for p in status.items() for x in p)), F.col("d.decision"))
    return labels.join(last, "label_id", "left").select("label_id", F.when(F.col("d.decision") == "edit", F.col("d.new_label")).otherwise(F.col("label")).alias("label"), F.coalesce(mapped, F.lit("unreviewed")).alias("review_status"))


def classification_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from pairs (gold, predicted)."""
    n = pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    by_gold = n.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_found = n.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("found"))
    df = by_gold.join(by_found, "label", "full_outer").na.fill(0)
    p, r = F.coalesce(F.try_divide("tp", "found"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return df.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def calibration(pairs: DataFrame, buckets: int = 5) -> DataFrame:
    """(bucket, n, confidence, accuracy) from pairs (confidence, correct)."""
    bucket = F.least(F.floor(F.col("confidence") * buckets), F.lit(buckets - 1)).cast("int")
    return pairs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


# The suites, the objects that each grades, and its graders.
SUITES = {
    "grounding": ("generated_answer", ("schema_integrity", "citation_integrity", "demographic_inference", "causal_overclaim", "insufficient_evidence_policy")),
    "retrieval": ("generated_answer", ("cross_version_contamination", "deleted_object_retrieval", "duplicate_evidence")),
    "classification": ("feedback_record", ("unsupported_label", "classification_demographic_inference", "low_confidence_rate")),
    "theme": ("theme", ("theme_naming_integrity", "representative_evidence", "source_concentration")),
}


def in_suite(results: DataFrame, suite: str) -> DataFrame:
    """The results of a suite's graders."""
    return results.where(F.col("grader").isin(*SUITES[suite][1]))


def answer_candidates(items: DataFrame, answers: DataFrame, findings: DataFrame, citations: DataFrame) -> DataFrame:
    """(object_id, missing, answer_text, citation_count, findings) for each of ``items`` (object_id): the answer with its findings in order, each with its citations.

    findings: (finding_id, answer_id, position, statement); citations: (finding_id, label, object_type, object_id).
    An item without its answer is missing: it fails.
    """
    cited = citations.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("label", "object_type", "object_id"))).alias("citations"))
    some = F.coalesce("citations", F.array().cast("array<struct<label:string,object_type:string,object_id:string>>"))
    whole = findings.join(cited, "finding_id", "left").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("position", "statement", some.alias("citations")))).alias("findings"))
    found = answers.join(whole, "answer_id", "left").select(F.col("answer_id").alias("object_id"), "answer_text", "citation_count", "findings", F.lit(False).alias("_there"))
    return items.join(found, "object_id", "left").select("object_id", F.coalesce("_there", F.lit(True)).alias("missing"), "answer_text", "citation_count", "findings")


def classification_candidates(items: DataFrame, records: DataFrame, analyses: DataFrame, labels: DataFrame, spans: DataFrame) -> DataFrame:
    """(object_id, missing, analysis_id, labels) for each of ``items`` (object_id): the newest analysis of the record, with its labels.

    analyses: (analysis_id, record_id, version, at); labels: (label_id, analysis_id, dimension, label_version, confidence);
    spans: (label_id, excerpt). A label tells whether it is of its own analysis' version. Records that are gone or have no analysis are missing.
    """
    newest = analyses.join(records.select("record_id"), "record_id", "left_semi").groupBy("record_id").agg(F.max_by(F.struct("analysis_id", "version"), F.struct("at", "analysis_id")).alias("a")).select(F.col("record_id").alias("object_id"), "a.*")
    excerpt = spans.groupBy("label_id").agg(F.min("excerpt").alias("excerpt"))
    full = newest.join(labels, "analysis_id").join(excerpt, "label_id", "left")
    one = F.struct("dimension", "label_id", "confidence", F.coalesce(F.col("label_version") == F.col("version"), F.lit(False)).alias("own_version"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))
    by = full.groupBy("object_id").agg(F.array_sort(F.collect_list(one)).alias("labels"))
    return items.join(newest, "object_id", "left").join(by, "object_id", "left").select("object_id", F.col("analysis_id").isNull().alias("missing"), "analysis_id", "labels")


def theme_candidates(items: DataFrame, themes: DataFrame, members: DataFrame) -> DataFrame:
    """(object_id, missing, name, member_count, has_representative, source_counts) for each of ``items`` (object_id); deleted themes are missing."""
    alive = themes.where("deleted_at is null").select(F.col("theme_id").alias("object_id"), "name")
    by = members.groupBy("theme_id", "connector").agg(F.count("*").alias("n"), F.bool_or("is_representative").alias("some"))
    sums = by.groupBy(F.col("theme_id").alias("object_id")).agg(F.sum("n").alias("member_count"), F.bool_or("some").alias("has_representative"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("connector", "n")))).alias("source_counts"))
    joined = items.join(alive, "object_id", "left").join(sums, "object_id", "left")
    there = F.col("name").isNotNull()
    return joined.select("object_id", (~there).alias("missing"), "name", F.when(there, F.coalesce("member_count", F.lit(0))).alias("member_count"), F.when(there, F.coalesce("has_representative", F.lit(False))).alias("has_representative"), F.when(there, F.col("source_counts")).alias("source_counts"))


def citation_lineage(citations: DataFrame, records: DataFrame, analyses: DataFrame, themes: DataFrame, theme_sets: DataFrame, insights: DataFrame, insight_sets: DataFrame) -> DataFrame:
    """(object_type, object_id, known, deleted, run_id) of each different cited object: whether it exists, is deleted, and the analysis run that it goes back to.

    A record's run is that of its newest analysis (record_id, run_id, at), a theme's and an insight's that of their set (set_id, run_id).
    The three kinds are resolved by their keys and put together, then joined once; an unknown kind is unknown.
    """
    newest = analyses.groupBy("record_id").agg(F.max_by("run_id", "at").alias("run_id"))
    part = lambda df, kind, key: df.select(F.lit(kind).alias("object_type"), F.col(key).alias("object_id"), F.col("deleted_at").isNotNull().alias("deleted"), "run_id")
    objects = (
        part(records.select("record_id", "deleted_at").join(newest, "record_id", "left"), "feedback_record", "record_id")
        .unionByName(part(themes.select("theme_id", "deleted_at", "set_id").join(theme_sets, "set_id", "left"), "theme", "theme_id"))
        .unionByName(part(insights.select("insight_id", "deleted_at", "set_id").join(insight_sets, "set_id", "left"), "insight", "insight_id"))
    )
    asked = citations.select("object_type", "object_id").distinct()
    return asked.join(objects, ["object_type", "object_id"], "left").select("object_type", "object_id", F.col("deleted").isNotNull().alias("known"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "run_id")


def latest_run_by_type(runs: DataFrame, datasets: DataFrame, types: tuple[str, ...] = ("classification", "retrieval", "theme", "grounding")) -> DataFrame:
    """(evaluation_type, run_id, status, at): the newest run (run_id, dataset_id, status, at) of each type of data set (dataset_id, evaluation_type); nulls where a type has none."""
    newest = runs.join(datasets.select("dataset_id", "evaluation_type"), "dataset_id").groupBy("evaluation_type").agg(F.max_by(F.struct("run_id", "status", "at"), F.struct("at", "run_id")).alias("r"))
    kinds = runs.sparkSession.createDataFrame([(t,) for t in types], "evaluation_type string")
    return kinds.join(newest, "evaluation_type", "left").select("evaluation_type", "r.run_id", "r.status", "r.at")


def review_queue(labels: DataFrame, analyses: DataFrame, records: DataFrame, dimensions: DataFrame, taxonomy: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """The unreviewed labels, the least sure first: (label_id, confidence, record_id, excerpt, dimension, dimension_name, label, label_name)."""
    open_ = labels.where("review_status = 'unreviewed'").select("label_id", "analysis_id", "dimension", "label", "confidence")
    whole = open_.join(analyses.select("analysis_id", "record_id"), "analysis_id").join(dimensions.select("dimension", "dimension_name"), "dimension").join(taxonomy.select("dimension", "label", "label_name"), ["dimension", "label"])
    page = whole.join(records.select("record_id", F.substring("redacted", 1, 240).alias("excerpt")), "record_id")
    return page.orderBy("confidence", "label_id").offset(offset).limit(limit).select("label_id", "confidence", "record_id", "excerpt", "dimension", "dimension_name", "label", "label_name")


def added_items(dataset: DataFrame, items: DataFrame) -> DataFrame:
    """items with accepted: false where their data set (dataset_id, status, partition) is locked or unknown, and blind_test, whose texts no prompt may hold."""
    known = dataset.select("dataset_id", (F.col("status") != "locked").alias("_open"), (F.col("partition") == "blind_test").alias("_blind"))
    return items.join(known, "dataset_id", "left").withColumn("accepted", F.coalesce("_open", F.lit(False))).withColumn("blind_test", F.coalesce("_blind", F.lit(False))).drop("_open", "_blind")


def unresolved(references: DataFrame, **objects: DataFrame) -> DataFrame:
    """references (object_type, object_id, ...) that lead to no row: ``objects`` gives, by type, a frame whose first column is the key."""
    keys = reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("object_type"), F.col(df.columns[0]).cast("string").alias("object_id")) for kind, df in objects.items()))
    return references.withColumn("object_id", F.col("object_id").cast("string")).join(keys.distinct(), ["object_type", "object_id"], "left_anti")
