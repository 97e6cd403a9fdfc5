"""The engine's entities over the given tables: the same formulas as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import records as rec
from feedloom.storage import spread

AS_OF = "2024-12-31"
#: Theme types and confidences of the ten labels; label 9 stands for outliers.
THEMES = (
    "exploration_barrier", "service_quality", "habit_signal", "unmet_need", "price_sensitivity", "information_need", "discovery_mechanism", "experimentation_signal", "repeat_category_driver", "outlier",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "documents").select(
        i.alias("record_id"),
        F.col("source").alias("connector"),
        "text",
        F.col("lang").alias("code"),
        F.when(i % 29 != 0, start + F.make_dt_interval((i % 365).cast("int"))).alias("published_at"),
        F.when(i % 17 != 0, (1 + i % 5).cast("double")).alias("rating_value"),
        F.lit(5.0).alias("rating_scale"),
        F.when(i % 4 != 0, i % 6).alias("severity"),
        F.when(i % 97 == 0, start).alias("deleted_at"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw(spark, sf_dir)
    return rec.canonical(df, F.col("code"))


STRIP = r"'^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


RAW_SQL = r"""raw as (
  select doc_id as record_id, source as connector, text, lang as code,
    case when doc_id % 29 <> 0 then timestamp '2024-01-01' + to_days((doc_id % 365)::int) end as published_at,
    case when doc_id % 17 <> 0 then (1 + doc_id % 5)::double end as rating_value, 5.0::double as rating_scale,
    case when doc_id % 4 <> 0 then doc_id % 6 end as severity,
    case when doc_id % 97 = 0 then timestamp '2024-01-01' end as deleted_at
  from documents)"""
NORMAL_SQL = (
    RAW_SQL
    + r""", normal as (select *, """
    + strip_sql(r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', E'\n\n', 'g')")
    + r""" as normalized from raw)"""
)
RECORDS_SQL = (
    NORMAL_SQL
    + r""", spoken as (
  select *, case when length(normalized) >= 12 then code end as language_code,
    length(normalized) >= 12 and regexp_matches(normalized, '[\x{900}-\x{97f}]') and regexp_matches(normalized, '[A-Za-z]{2,}') as is_mixed
  from normal),
records as (
  select *, coalesce(is_mixed or language_code in ('en', 'hi'), false) as is_supported, sha256(normalized) as content_hash,
    case when normalized = '' or regexp_matches(normalized, '(?i)^[\t-\r ]*https?://[^\t-\r ]+[\t-\r ]*$') then 'insufficient_content'
      when contains(lower(normalized), 'click here to win') or contains(lower(normalized), 'free gift card') or contains(lower(normalized), 'whatsapp me at') or contains(lower(normalized), 'dm me for a discount code') then 'spam_or_promotion'
      else 'unreviewed' end as relevance,
    case when """
    + strip_sql("coalesce(text, '')")
    + r""" <> '' and normalized = '' then 'malformed'
      when language_code is not null and not is_mixed and language_code not in ('en', 'hi') then 'unsupported_language'
      when length(normalized) < 15 then 'low_information' else 'usable' end as quality
  from spoken)"""
)
ELIGIBLE_SQL = "quality in ('usable', 'low_information') and relevance not in ('insufficient_content', 'spam_or_promotion') and deleted_at is null"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, theme_id, embedding), outliers included (theme 9)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("label").cast("long").alias("theme_id"), "embedding")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme members by label, with the record's connector and time and a score from its id."""
    v = vectors(spark, sf_dir).drop("embedding").where("theme_id <> 9")
    r = raw(spark, sf_dir).select("record_id", "connector", "published_at")
    return v.join(r, "record_id").withColumn("membership_score", 0.5 + (F.col("record_id") % 50) / 100.0)


MEMBERS_SQL = (
    RAW_SQL
    + """, members as (
  select e.label::bigint as theme_id, r.record_id, r.connector, r.published_at, 0.5 + (r.record_id % 50) / 100.0::double as membership_score
  from embeddings e join raw r on e.vec_id = r.record_id where e.label <> 9),
ranked as (
  select *, row_number() over (partition by theme_id order by membership_score desc, record_id) as rank, count(*) over (partition by theme_id) as n from members),
marked as (select *, rank <= least(5, n) as is_representative, rank = n and rank > least(5, n) as is_counterexample from ranked)"""
)


def themes(spark: SparkSession) -> DataFrame:
    rows = [(n, kind, 0.5 + n / 20.0, f"theme {n}") for n, kind in enumerate(THEMES[:9])]
    return spark.createDataFrame(rows, "theme_id long, theme_type string, confidence double, name string")


THEMES_SQL = "themes(theme_id, theme_type, confidence, name) as (values " + ", ".join(f"({n}::bigint, '{k}', {0.5 + n / 20.0}::double, 'theme {n}')" for n, k in enumerate(THEMES[:9])) + ")"

#: The offline classifier's keywords: (dimension, label) to a word of the texts.
KEYWORDS = {("journey_stage", "first"): "the", ("journey_stage", "second"): "que", ("frustration", "third"): "and", ("unmet_need", "fourth"): "der"}


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.operators.grounding import keyword_labels

    return keyword_labels(raw(spark, sf_dir).select("record_id", "text"), KEYWORDS)


LABELS_SQL = (
    "labels as ("
    + " union all ".join(f"select record_id, '{d}' as dimension, '{name}' as label, 0.4 + (record_id % 6) / 10.0::double as confidence, strpos(text, '{w}') as spot, '{w}' as word from raw where contains(lower(text), '{w}')" for (d, name), w in KEYWORDS.items())
    + ")"
)
