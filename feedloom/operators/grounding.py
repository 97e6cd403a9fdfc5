"""Rules that findings, answers and insights have to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import causal, demographic, located, stripped

PLACEHOLDER = "[removed: unsupported inference]"
NOT_ENOUGH = "There is not enough retrieved evidence in the current dataset to answer this question. Try broadening the question, removing filters, or expanding the analyzed dataset."  # fixed value


def resolved_citations(findings: DataFrame, package: DataFrame) -> DataFrame:
    """(finding_id, label, object_type, object_id, role): the findings' labels that the package has; counterexamples contradict.

    package: (label, object_type, object_id, is_counterexample), a few dozen rows.
    """
    spread = findings.select("finding_id", F.explode("labels").alias("label"))
    role = F.when(F.col("is_counterexample"), "contradictory").otherwise("supporting")
    return spread.join(package, "label").select("finding_id", "label", "object_type", "object_id", role.alias("role"))


def validated(findings: DataFrame, package: DataFrame) -> DataFrame:
    """findings (finding_id, answer_id, statement, labels) with resolved, dropped, redacted, support_status and warnings, "type:severity" in the order of the checks."""
    counts = resolved_citations(findings, package).groupBy("finding_id").agg(F.count("*").alias("resolved"))
    df = findings.join(counts, "finding_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(0).cast("long")))
    df = df.withColumn("dropped", F.coalesce(F.size("labels"), F.lit(0)) - F.col("resolved")).withColumn("redacted", demographic(F.col("statement")))
    warnings = F.array(
        F.when(F.col("dropped") > 0, "unresolvable_citation:warning"),
        F.when(F.col("redacted"), "possible_demographic_inference:error"),
        F.when(~F.col("redacted") & causal(F.col("statement")), "causal_overclaim:warning"),
        F.when(~F.col("redacted") & (F.col("resolved") == 0), "insufficient_evidence:warning"),
    )
    return df.withColumn("warnings", F.array_compact(warnings)).withColumn("support_status", F.when(F.col("redacted") | (F.col("resolved") == 0), "unsupported").otherwise("supported")).withColumn("statement", F.when(F.col("redacted"), PLACEHOLDER).otherwise(F.col("statement")))


def answer_status(checked: DataFrame) -> DataFrame:
    """(answer_id, findings, kept, warnings, grounding_status)."""
    error = F.exists("warnings", lambda w: w.endswith(":error"))
    a = checked.groupBy("answer_id").agg(
        F.count("*").alias("findings"), F.count_if(F.col("support_status") == "supported").alias("kept"), F.sum(F.size("warnings")).alias("warnings"), F.bool_or(error).alias("_error"), F.bool_or(F.size("labels") > 0).alias("_cited")
    )
    status = F.when(F.col("_error") | ((F.col("kept") == 0) & F.col("_cited")), "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed")
    return a.select("answer_id", "findings", "kept", "warnings", status.alias("grounding_status"))


def question_status(grounding: Column) -> Column:
    return F.when(grounding == "passed", "completed").when(grounding.isNull(), "failed").otherwise("completed_with_warnings")


#: The steps of a question in their order, each with the status that it stands for once begun.
STEPS = ("created", "planning", "retrieving", "generating", "answered")


def question_states(log: DataFrame) -> DataFrame:
    """log (question_id, step, at, failure_code, grounding_status) to (question_id, status, started_at, completed_at, failure_code).

    A failure ends a question, whatever came before; an answer ends it by its grounding; else it
    stands at its furthest step. It starts with its planning. Steps that aren't known, and rows
    of no question, are left out.
    """
    known = log.where(F.col("step").isin(*STEPS) & F.col("question_id").isNotNull()).withColumn("_place", F.array_position(F.array(*map(F.lit, STEPS)), F.col("step")))
    failed = F.col("failure_code").isNotNull()
    q = known.groupBy("question_id").agg(
        F.max("_place").alias("_furthest"),
        F.min(F.when(F.col("step") == "planning", F.col("at"))).alias("started_at"),
        F.min(F.when(failed, F.struct("at", "failure_code"))).alias("_failure"),
        F.max(F.when((F.col("step") == "answered") & ~failed, F.struct("at", "grounding_status"))).alias("_answer"),
    )
    open_status = F.element_at(F.array(*map(F.lit, STEPS)), F.col("_furthest").cast("int"))
    status = F.when(F.col("_failure").isNotNull(), "failed").when(F.col("_answer").isNotNull(), question_status(F.col("_answer.grounding_status"))).otherwise(open_status)
    return q.select("question_id", status.alias("status"), "started_at", F.coalesce("_failure.at", "_answer.at").alias("completed_at"), F.col("_failure.failure_code").alias("failure_code"))


def publishability(insights: DataFrame) -> DataFrame:
    """insights (insight_id, insight_type, has_theme_link, support_count, recommendation, opportunity_score, has_components) with violated and publishable. A rule may be violated twice."""
    rules = F.array(
        F.when(~F.col("has_theme_link") & (F.col("support_count") <= 0), "INS-001"),
        F.when((F.col("insight_type") == "synthesized_insight") & (F.col("support_count") == 0), "INS-001"),
        F.when((F.col("insight_type") == "product_hypothesis") & (stripped(F.coalesce("recommendation", F.lit(""))) == ""), "INS-010"),
        F.when(F.col("opportunity_score").isNotNull() & ~F.coalesce("has_components", F.lit(False)), "INS-015"),
    )
    return insights.withColumn("violated", F.array_compact(rules)).withColumn("publishable", F.size("violated") == 0)


def guarded(text: Column) -> Column:
    return F.when(demographic(text), PLACEHOLDER).otherwise(text)


def persisted_labels(found: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """found (record_id, text, dimension, label, confidence, excerpt) that the taxonomy knows and no demographic excerpt spoils, with the excerpt's place."""
    kept = found.where(~demographic(F.coalesce("excerpt", F.lit("")))).join(taxonomy, ["dimension", "label"], "left_semi")
    return kept.withColumn("_at", located(F.col("text"), F.col("excerpt"))).select("record_id", "dimension", "label", "confidence", F.col("_at.start").alias("start_offset"), F.col("_at.end").alias("end_offset"))


def keyword_labels(records: DataFrame, rules: dict[tuple[str, str], str]) -> DataFrame:
    """(record_id, text, dimension, label, confidence, excerpt): labels by keyword, the offline classifier; its excerpt is the keyword."""
    hits = [F.when(F.contains(F.lower("text"), F.lit(word)), F.struct(F.lit(d).alias("dimension"), F.lit(name).alias("label"), F.lit(word).alias("excerpt"))) for (d, name), word in rules.items()]
    spread = records.withColumn("_l", F.explode(F.array_compact(F.array(*hits))))
    return spread.select("record_id", "text", "_l.dimension", "_l.label", (0.4 + (F.col("record_id") % 6) / 10.0).alias("confidence"), "_l.excerpt")


def unanswered(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """The fixed answer of each question (question_id) that no evidence (question_id, ...) was found for: one warning, nothing cited."""
    empty = questions.select("question_id").join(evidence.select("question_id"), "question_id", "left_anti")
    return empty.select("question_id", F.lit(NOT_ENOUGH).alias("answer_text"), F.lit("passed_with_warnings").alias("grounding_status"), F.lit(0).alias("citation_count"), F.lit(1).alias("warning_count"), F.lit("insufficient_evidence").alias("warning_type"))
