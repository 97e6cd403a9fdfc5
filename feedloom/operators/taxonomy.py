"""The versioned taxonomy: active labels in order, its text for prompts, and what a classifier may answer.

A version has few labels (dozens), so the frames of this module are small; what they are applied to need not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.window import Window

# The parts of an answer that no taxonomy changes, with their bounds.
SENTIMENTS = ("positive", "neutral", "negative", "mixed")
RANGES = {"sentiment_score": (-1.0, 1.0), "sentiment_confidence": (0.0, 1.0), "severity_value": (0, 5), "severity_confidence": (0.0, 1.0), "overall_confidence": (0.0, 1.0)}
LABEL = StructType().add("label", StringType()).add("confidence", DoubleType()).add("evidence_excerpt", StringType())


def active(dimensions: DataFrame, labels: DataFrame, version: str) -> DataFrame:
    """(dimension, display_name, dimension_order, label_id, label, definition, parent_id, place) of a version's active labels in their order; a dimension without any has one row of nulls."""
    own = dimensions.where(F.col("version") == version).select("dimension_id", F.col("key").alias("dimension"), "display_name", F.col("sort_order").alias("dimension_order"))
    some = labels.where("is_active").select("dimension_id", "label_id", F.col("key").alias("label"), "definition", "parent_id", F.col("sort_order").alias("label_order"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.asc_nulls_last("label_order"), "label"))
    return own.join(some, "dimension_id", "left").withColumn("place", place).drop("dimension_id", "label_order")


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the SHA-256 of a version's rows as JSON in sorted order; a version is loaded again only if it differs."""
    lines = F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})))
    return rows.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("checksum"))


def rendered(rows: DataFrame) -> DataFrame:
    """One row, text: the taxonomy (as ``active`` gives it) as bullets, labels under their dimension.

    A dimension all of whose labels have a parent among the rows has no heading of its own: its labels stand under their parents.
    """
    named = rows.where("label_id is not null")
    parents = named.select(F.col("label_id").alias("parent_id"), F.lit(True).alias("_known"), F.col("place").alias("_p"))
    up = named.join(parents, "parent_id", "left")
    folded = up.groupBy("dimension").agg(F.bool_and(F.col("_known").isNotNull()).alias("folded"))
    kids = up.where("_known").groupBy(F.col("parent_id").alias("label_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dimension_order", "place", "label", "definition"))), lambda x: F.concat(F.lit("\n        - "), x["label"], F.lit(": "), x["definition"])), "").alias("kids")
    )
    line = F.concat(F.lit("\n    - "), "label", F.lit(": "), "definition", F.coalesce("kids", F.lit("")))
    lines = named.join(kids, "label_id", "left").groupBy("dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    heads = rows.select("dimension", "display_name", "dimension_order").distinct().join(folded, "dimension", "left").where("not coalesce(folded, false)").join(lines, "dimension", "left")
    text = F.concat(F.lit("- "), "dimension", F.lit(" ("), "display_name", F.lit("):"), F.coalesce("lines", F.lit("")))
    return heads.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dimension_order", "dimension", text.alias("text")))), lambda x: x["text"]), "\n").alias("text"))


def answer_schema(dimensions: list[str], topics_only: bool = False) -> StructType:
    """What a classifier's JSON is read with: a list of labels for each dimension that has labels, which may be empty."""
    schema = StructType()
    if not topics_only:
        schema.add("sentiment_label", StringType())
        for name in RANGES:
            schema.add(name, IntegerType() if name == "severity_value" else DoubleType())
        schema.add("summary", StringType())
    for name in dimensions:
        schema.add(name, ArrayType(LABEL))
    return schema


def checked_answers(answers: DataFrame, allowed: dict[str, list[str]], column: str = "answer") -> DataFrame:
    """answers with parsed and problem: null, or the first of: unreadable, a part that is missing or out of its range, a label that its dimension hasn't.

    allowed: each dimension's label keys. A list of labels that is left out counts as empty.
    """
    dimensions = [d for d, keys in allowed.items() if keys]
    parsed = F.from_json(column, answer_schema(dimensions))
    df = answers.select("*", F.inline(F.array(F.struct(parsed.alias("parsed")))))
    known = lambda d: F.array(*map(F.lit, allowed[d]))

    def odd(d: str) -> Column:
        found = F.coalesce(F.col("parsed")[d], F.array().cast(ArrayType(LABEL)))
        return F.exists(found, lambda x: F.coalesce(~F.array_contains(known(d), x["label"]) | ~x["confidence"].between(0.0, 1.0), F.lit(True)))

    x = F.col("parsed")
    checks = [("unreadable", x.isNull() | F.coalesce(~F.get_json_object(column, "$").startswith("{"), F.lit(True))), ("sentiment_label", ~F.coalesce(x["sentiment_label"].isin(*SENTIMENTS), F.lit(False)))]
    checks += [(name, ~F.coalesce(x[name].between(lo, hi), F.lit(False))) for name, (lo, hi) in RANGES.items()]
    checks += [("summary", x["summary"].isNull()), *((d, odd(d)) for d in dimensions)]
    return df.withColumn("problem", F.coalesce(*(F.when(bad, name) for name, bad in checks)))


def evidence_block(records: DataFrame, most: int = 500) -> DataFrame:
    """(theme_id, block) of a theme's representatives and counterexample (theme_id, record_id, redacted, rank, is_counterexample): numbered excerpts, the counterexample last."""
    n = F.row_number().over(Window.partitionBy("theme_id", "is_counterexample").orderBy("rank"))
    line = F.concat(F.when(F.col("is_counterexample"), "[counterexample] ").otherwise(F.concat(F.lit("["), n, F.lit("] "))), F.substring("redacted", 1, most))
    lines = records.select("theme_id", F.struct("is_counterexample", "rank", line.alias("line")).alias("x"))
    return lines.groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("block"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A prompt's template with {{name}} replaced by each value; null values leave nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template
