"""Lists, details, facets, feeds and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import excerpt, first_filled


def evidence_page(records: DataFrame, connectors: DataFrame, search: str | None = None, source: str | None = None, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): newest first, nulls last. In the search text % and _ are wildcards. connectors: (connector, display)."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100, offset 0 or more")
    df = records.where("deleted_at is null")
    df = df if source is None else df.where(F.col("connector") == source)
    df = df if search is None else df.where(F.col("redacted").ilike(f"%{search}%"))
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(F.desc_nulls_last("published_at"), "record_id").offset(offset).limit(limit)
    named = page.join(connectors, "connector", "left")
    return named.select("record_id", F.coalesce("display", F.lit("unknown")).alias("source_name"), "published_at", excerpt(F.col("redacted"), 240).alias("excerpt")), total


def evidence_detail(records: DataFrame, connectors: DataFrame, record_id: int) -> DataFrame:
    """One record whole, deleted or not; no row where there is none."""
    one = records.where(F.col("record_id") == record_id).join(connectors, "connector", "left")
    return one.select("record_id", F.coalesce("display", F.lit("unknown")).alias("source_name"), "published_at", excerpt(F.col("redacted"), 240).alias("excerpt"), F.col("text").alias("original_text"), F.col("redacted").alias("redacted_text"), F.col("language.code").alias("language_code"))


def theme_detail(themes: DataFrame, members: DataFrame, tags: DataFrame, records: DataFrame, theme_id: int) -> DataFrame:
    """One row: the theme with its tags by place, its representatives by rank, and its counterexample (as record_id, excerpt)."""
    own = members.where((F.col("theme_id") == theme_id) & (F.col("is_representative") | F.col("is_counterexample")))
    shown = own.join(records.select("record_id", excerpt(F.col("redacted"), 240).alias("excerpt")), "record_id")
    entry = F.struct("rank", "record_id", "excerpt")
    marks = shown.groupBy("theme_id").agg(F.array_sort(F.collect_list(F.when(F.col("is_representative"), entry))).alias("representatives"), F.min(F.when(F.col("is_counterexample"), entry)).alias("counterexample"))
    named = tags.where(F.col("theme_id") == theme_id).groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "dimension", "label", "records"))), lambda x: F.concat_ws(":", x["dimension"], x["label"], x["records"])).alias("tags"))
    return themes.where(F.col("theme_id") == theme_id).join(named, "theme_id", "left").join(marks, "theme_id", "left")


def insight_list(insights: DataFrame, sets: DataFrame) -> DataFrame:
    """The newest set's insights that aren't deleted, by score. insights: (insight_id, set_id, ...); sets: (set_id, at)."""
    newest = sets.agg(F.max_by("set_id", F.struct("at", "set_id")).alias("set_id"))
    return insights.where("deleted_at is null").join(newest, "set_id", "left_semi").orderBy(F.desc_nulls_last("opportunity_score"), "insight_id")


def insight_detail(insights: DataFrame, links: DataFrame, themes: DataFrame, evidence: DataFrame, records: DataFrame, connectors: DataFrame, insight_id: int) -> DataFrame:
    """One row: the insight with its themes, and its evidence by relevance. A record that is gone shows the excerpt that was kept of it.

    links: (insight_id, theme_id, relationship); evidence: (insight_id, evidence_id, record_id, role, relevance, kept).
    """
    own = lambda df: df.where(F.col("insight_id") == insight_id)
    named = own(links).join(themes.select("theme_id", "name"), "theme_id", "left").groupBy("insight_id").agg(F.array_sort(F.collect_list(F.struct("theme_id", F.coalesce("name", F.lit("unknown")).alias("name"), "relationship"))).alias("themes"))
    there = records.select("record_id", "connector", "published_at", F.col("redacted").alias("_now")).join(connectors.select("connector", "display"), "connector", "left")
    full = own(evidence).join(there, "record_id", "left")
    shown = F.struct((-F.coalesce("relevance", F.lit(-1.0))).alias("order"), "evidence_id", excerpt(F.coalesce("_now", "kept"), 240).alias("excerpt"), "role", F.coalesce("display", F.lit("unknown")).alias("source_name"), "published_at")
    listed = full.groupBy("insight_id").agg(F.array_sort(F.collect_list(shown)).alias("evidence"))
    return own(insights).where("deleted_at is null").join(named, "insight_id", "left").join(listed, "insight_id", "left")


def snapshots(asked: DataFrame, records: DataFrame, themes: DataFrame, metrics: DataFrame, insights: DataFrame, answers: DataFrame) -> DataFrame:
    """(object_type, object_id, snapshot) of what a report cites: by type a few fields as JSON; null where the object is gone, which must not be linked."""
    part = lambda df, kind, key, *fields: df.select(F.lit(kind).alias("object_type"), F.col(key).cast("string").alias("object_id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("snapshot"))
    known = (
        part(records, "feedback_record", "record_id", excerpt(F.col("redacted"), 500).alias("excerpt"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"))
        .unionByName(part(themes, "theme", "theme_id", "name", "short_summary", "theme_type"))
        .unionByName(part(metrics, "theme_metric", "metric_id", "metric_key", "numeric_value", "text_value"))
        .unionByName(part(insights, "insight", "insight_id", "title", "finding", "insight_type"))
        .unionByName(part(answers, "generated_answer", "answer_id", excerpt(F.col("answer_text"), 500).alias("answer_text"), "citation_count"))
    )
    return asked.select("object_type", F.col("object_id").cast("string").alias("object_id")).join(known, ["object_type", "object_id"], "left")


def source_facet(records: DataFrame, connectors: DataFrame) -> DataFrame:
    """The connectors that have records."""
    return connectors.join(records.where("deleted_at is null").select("connector").distinct(), "connector", "left_semi").orderBy("connector")


def run_feed(*runs: DataFrame, most: int = 50) -> DataFrame:
    """The newest of several tables of runs (run_type, run_id, started_at): the newest of each, merged."""
    newest = lambda df: df.orderBy(F.desc_nulls_last("started_at"), "run_type", "run_id").limit(most)
    out = newest(runs[0])
    for df in runs[1:]:
        out = out.unionByName(newest(df))
    return newest(out)


def next_number(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def reordered(sections: DataFrame, ids: list[int]) -> DataFrame:
    """Sections (section_id, ...) with position 1..n in the order of ``ids``."""
    order = sections.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids, 1)], "section_id long, position int")
    return sections.drop("position").join(order, "section_id")


def report_label(*columns: str):
    return excerpt(first_filled(*(F.col(c) for c in columns)), 80)


def markdown(title: str, sections: DataFrame) -> str:
    """A report's few sections (position, heading, body) as Markdown."""
    parts = [f"# {title}"]
    for r in sections.orderBy("position").collect():
        parts += [f"## {r['heading']}", r["body"] or ""]
    return "\n\n".join(parts) + "\n"


def as_json(title: str, sections: DataFrame) -> str:
    return json.dumps({"title": title, "sections": [r.asDict() for r in sections.orderBy("position").collect()]}, ensure_ascii=False, default=str)


def as_html(text: str) -> str:
    """Headings, list items and paragraphs of Markdown, one to a line, escaped."""
    out = []
    for line in text.split("\n"):
        safe = html.escape(line.lstrip("#- ").strip() if line.startswith(("#", "- ")) else line)
        level = len(line) - len(line.lstrip("#"))
        out.append(f"<h{level}>{safe}</h{level}>" if 1 <= level <= 3 else f"<li>{safe}</li>" if line.startswith("- ") else "<br>" if not line.strip() else f"<p>{safe}</p>")
    return "\n".join(out)
