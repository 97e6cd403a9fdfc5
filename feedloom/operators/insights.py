"""Insights: what a generator is asked, what its answers become, and the state of their set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import delimited
from feedloom.operators.grounding import guarded, publishability
from feedloom.operators.taxonomy import evidence_block, filled

MOST_EXCERPT = 500
GUARDED = ("finding", "interpretation", "affected_context", "product_implication")


def prompts(themes: DataFrame, members: DataFrame, records: DataFrame, template: str) -> DataFrame:
    """(theme_id, prompt) of each theme (theme_id, name, summary, opportunity_score) that has representatives.

    members: (theme_id, record_id, rank, is_representative, is_counterexample); records: (record_id, redacted).
    """
    shown = members.where("is_representative or is_counterexample").join(records.select("record_id", "redacted"), "record_id")
    counts = members.groupBy("theme_id").agg(F.count("*").alias("n"), F.bool_or("is_representative").alias("some")).where("some")
    df = themes.join(counts, "theme_id").join(evidence_block(shown, MOST_EXCERPT), "theme_id")
    score = F.coalesce(F.format_string("%.2f", "opportunity_score"), F.lit("not yet scored"))
    values = {"THEME_NAME": F.col("name"), "THEME_SUMMARY": F.col("summary"), "RECORD_COUNT": F.col("n"), "OPPORTUNITY_SCORE": F.when(F.col("opportunity_score").isNull(), "not yet scored").otherwise(score), "UNTRUSTED_CONTENT": delimited(F.col("block"))}
    return df.select("theme_id", filled(F.lit(template), values).alias("prompt"))


def generated(themes: DataFrame, members: DataFrame, records: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(insights, evidence) of the generator's ``answers`` (theme_id, insight_type, title, the texts of GUARDED, recommendation, citations: array<struct<number, role, relevance>>).

    Citation number n is the theme's nth representative, 0 its counterexample; other numbers fall out.
    Score and components are the theme's at this time; unsafe texts are replaced; each insight says which rules keep it from publication.
    """
    offered = members.where("is_representative or is_counterexample").select("theme_id", "record_id", F.when(F.col("is_counterexample"), 0).otherwise(F.col("rank")).cast("int").alias("number"))
    some = members.where("is_representative").select("theme_id").distinct()
    asked = answers.join(some, "theme_id", "left_semi")
    cited = asked.select("theme_id", F.inline("citations")).join(offered, ["theme_id", "number"]).join(records.select("record_id", "redacted"), "record_id")
    kept = F.substring("redacted", 1, MOST_EXCERPT)
    evidence = cited.select("theme_id", "record_id", "role", "relevance", kept.alias("kept"), F.lit(0).alias("start_offset"), F.length(kept).alias("end_offset"))
    support = evidence.groupBy("theme_id").agg(F.count_if(F.col("role") == "supporting").alias("support_count"))
    scored = themes.select("theme_id", "opportunity_score", "components")
    df = asked.drop("citations").join(scored, "theme_id").join(support, "theme_id", "left").withColumn("support_count", F.coalesce("support_count", F.lit(0)))
    df = df.withColumns({c: guarded(F.col(c)) for c in GUARDED}).withColumn("has_theme_link", F.lit(True)).withColumn("has_components", F.col("components").isNotNull())
    return publishability(df), evidence


def set_status(themes: Column, done: Column, failed: Column) -> Column:
    """State of an insight set: rejected without insights, a draft while any theme is without one, else ready_for_review."""
    return F.when(done == 0, "rejected").when((failed > 0) | (done < themes), "draft").otherwise("ready_for_review")
