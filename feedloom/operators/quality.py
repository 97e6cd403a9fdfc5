"""Declared constraints, checked in one scan; unique keys and references by aggregates and anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Constraints of the canonical record.
RECORD_RULES = {
    "relevance_domain": "relevance in ('unreviewed', 'insufficient_content', 'spam_or_promotion')",
    "quality_domain": "quality in ('usable', 'low_information', 'unsupported_language', 'malformed')",
    "rating_range": "rating is null or rating between 0 and 1",
    "severity_range": "severity is null or severity between 0 and 5",
    "no_self_duplicate": "duplicate_of is null or duplicate_of != record_id",
    "hash_length": "length(content_hash) = 64",
}


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations): rows for which a rule is false; an unknown (null) outcome violates nothing."""
    counts = df.agg(*(F.count_if(~F.expr(p)).alias(n) for n, p in rules.items()))
    return counts.unpivot([], list(rules), "rule", "violations")


def exactly_one(*columns: str) -> str:
    """A rule: one of the columns is filled and the others aren't."""
    return " + ".join(f"int({c} is not null)" for c in columns) + " = 1"


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is filled and leads nowhere."""
    return df.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")
