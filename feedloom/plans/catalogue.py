"""Every registered query of the feedback engine, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.plans import feed_queries, fixtures, keyword_queries, landing_queries, review_queries, stream_queries, text_queries, theme_queries  # noqa: F401  the modules register their queries
from feedloom.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records by source: how many there are, may be analysed and were redacted."""
    r = fixtures.records(spark, sf_dir)
    usable = F.col("quality").isin("usable", "low_information") & (F.col("relevance") == "unreviewed") & F.col("deleted_at").isNull()
    return r.groupBy("connector").agg(F.count("*").alias("records"), F.count_if(usable).alias("eligible"), F.count_if(F.size("events") > 0).alias("redacted")).orderBy("connector")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
