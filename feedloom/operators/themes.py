"""Themes: members ranked by likeness to their centroid, metrics, opportunity scores, set quality, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions.text import clamped
from feedloom.storage import stored

REPRESENTATIVES, TAGS, RECENT_DAYS = 5, 20, 90
MIDDLE_SEVERITY = 2.0
# The weights of an opportunity's components, and the theme types that bear on discovery.
WEIGHTS = {"frequency": 0.25, "severity": 0.20, "recency": 0.10, "source_breadth": 0.15, "confidence": 0.10, "discovery_relevance": 0.10, "actionability": 0.10}
DISCOVERY_TYPES = ("repeat_category_driver", "exploration_barrier", "discovery_mechanism", "habit_signal", "experimentation_signal", "unmet_need", "information_need")


def centroids(vectors: DataFrame) -> DataFrame:
    """(theme_id, centroid): the unit mean of each theme's vectors (theme_id, embedding).

    Means are taken by dimension, so they combine before the shuffle and no task sees a theme's vectors.
    """
    spread = vectors.select("theme_id", F.posexplode("embedding").alias("at", "x"))
    means = spread.groupBy("theme_id", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy("theme_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda p: p["m"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return whole.select("theme_id", F.transform("mean", lambda x: x / norm).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def memberships(vectors: DataFrame, representatives: int = REPRESENTATIVES) -> DataFrame:
    """vectors (record_id, theme_id, embedding) with score, rank and the two marks.

    The highest-scored members are representative; a theme with more members than that has the
    last-ranked one as its counterexample. Equal scores follow record_id.
    """
    scored = vectors.join(centroids(vectors), "theme_id")
    return ranked(scored.withColumn("membership_score", clamped(dot(F.col("embedding"), F.col("centroid")))).drop("centroid"), representatives)


def ranked(scored: DataFrame, representatives: int = REPRESENTATIVES) -> DataFrame:
    """scored (theme_id, record_id, membership_score, ...) with rank and the two marks.

    The rows are put in order by ranges of (theme, score, record), so that a theme may cover many parts; each part
    ranks its own rows, and the rows of a theme in the parts before are summed. No task has a whole theme.
    """
    order = (F.desc("membership_score"), F.asc("record_id"))
    dealt = stored(scored.repartitionByRange("theme_id", *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("theme_id", "_part").agg(F.count("*").alias("_rows"))
    along = Window.partitionBy("theme_id").orderBy("_part")
    before = counts.select("theme_id", "_part", (F.sum("_rows").over(along) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy("theme_id")).alias("_n"))
    own = Window.partitionBy("theme_id", "_part").orderBy(*order)
    df = dealt.withColumn("_place", F.row_number().over(own)).join(before, ["theme_id", "_part"])
    df = df.withColumn("rank", (F.col("_before") + F.col("_place")).cast("int")).withColumn("is_representative", F.col("rank") <= F.least(F.lit(representatives), F.col("_n")))
    return df.withColumn("is_counterexample", (F.col("rank") == F.col("_n")) & ~F.col("is_representative")).drop("_n", "_part", "_place", "_before")


def metrics(members: DataFrame, themes: DataFrame, severities: DataFrame, eligible: int, connectors: int, as_of: str) -> DataFrame:
    """A row for each theme: counts, shares, components and the opportunity score.

    members: (theme_id, record_id, connector, published_at, membership_score, is_counterexample);
    themes: (theme_id, theme_type, confidence); severities: (record_id, severity), of any run.
    All members count, duplicates too.
    """
    recent = F.col("published_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {RECENT_DAYS} DAYS")
    base = members.groupBy("theme_id").agg(
        F.count("*").alias("record_count"),
        F.countDistinct("connector").alias("sources"),
        F.count_if(recent).alias("recent"),
        F.avg("membership_score").alias("coherence"),
        F.coalesce(F.bool_or("is_counterexample"), F.lit(False)).alias("has_counterexample"),
    )
    grades = members.select("theme_id", "record_id").join(severities, "record_id").groupBy("theme_id").agg(F.avg("severity").alias("average_severity"))
    df = themes.join(base, "theme_id", "left").join(grades, "theme_id", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0).cast("long")))
    n = F.col("record_count")
    share = F.lit(0.0) if eligible == 0 else n / float(eligible)
    df = df.withColumn("record_share", share).withColumn("source_breadth", F.coalesce("sources", F.lit(0).cast("long"))).withColumn("recency_share", F.when(n > 0, F.col("recent") / n).otherwise(0.0))
    parts = {
        "frequency": clamped(F.col("record_share")),
        "severity": clamped(F.coalesce("average_severity", F.lit(MIDDLE_SEVERITY)) / 5),
        "recency": F.col("recency_share"),
        "source_breadth": clamped(F.col("source_breadth") / float(max(1, connectors))),
        "confidence": clamped(F.coalesce(F.col("confidence"), F.lit(0.5))),
        "discovery_relevance": F.when(F.col("theme_type").isin(*DISCOVERY_TYPES), 0.9).otherwise(0.5),
        "actionability": clamped(0.5 + F.when(F.col("has_counterexample"), 0.2).otherwise(0.0) + 0.2 * F.coalesce("coherence", F.lit(0.0))),
    }
    df = df.withColumn("components", F.struct(*(c.alias(k) for k, c in parts.items())))
    score = sum((F.col(f"components.{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("opportunity_score", 100 * score).drop("recent", "sources")


def metric_rows(scored: DataFrame, members: DataFrame) -> DataFrame:
    """(theme_id, metric_key, numeric_value, json_value): the metrics that are kept, one to a row; nulls have none.

    source_distribution has no number but a JSON object: the theme's connectors in order, each with null.
    """
    keys = {"record_count": "record_count", "record_share": "record_share", "source_breadth": "source_breadth", "coherence_score": "coherence", "opportunity_score": "opportunity_score"}
    wide = scored.select("theme_id", *(F.col(c).cast("double").alias(k) for k, c in keys.items()))
    numbers = wide.unpivot("theme_id", list(keys), "metric_key", "numeric_value").where("numeric_value is not null").withColumn("json_value", F.lit(None).cast("string"))
    known = members.groupBy("theme_id").agg(F.sort_array(F.collect_set("connector")).alias("connectors"))
    names = scored.select("theme_id").join(known, "theme_id", "left").select("theme_id", F.coalesce("connectors", F.array().cast("array<string>")).alias("connectors"))
    entries = F.map_from_arrays("connectors", F.transform("connectors", lambda c: F.lit(None).cast("string")))
    spread = names.select("theme_id", F.lit("source_distribution").alias("metric_key"), F.lit(None).cast("double").alias("numeric_value"), F.to_json(entries, {"ignoreNullFields": "false"}).alias("json_value"))
    return numbers.unionByName(spread)


def source_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("theme_id", "connector").agg(F.count("*").alias("records"))


def concentration(members: DataFrame, most: float = 0.9) -> DataFrame:
    """(theme_id, top_share, passed): the largest source's share of a theme."""
    by = source_counts(members).groupBy("theme_id").agg((F.max("records") / F.sum("records")).alias("top_share"))
    return by.withColumn("passed", F.col("top_share") < most)


def set_quality(members: DataFrame, eligible: int, outliers: int) -> DataFrame:
    """One row: coverage, outlier_rate, mean_overlap (Jaccard over all pairs of themes) and multi_theme_share.

    Only pairs that share records are joined, on the record; pairs that share none count zero
    through the number of pairs.
    """
    distinct = members.select("theme_id", "record_id").distinct()
    sizes = distinct.groupBy("theme_id").agg(F.count("*").alias("n"))
    per_record = distinct.groupBy("record_id").agg(F.sort_array(F.collect_set("theme_id")).alias("t"))
    several = per_record.where(F.size("t") > 1).select(F.explode(F.expr("flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> struct(x as a, y as b))))")).alias("p"))
    shared = several.groupBy("p.a", "p.b").agg(F.count("*").alias("both"))
    like = shared.join(sizes.select(F.col("theme_id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("theme_id").alias("b"), F.col("n").alias("nb")), "b")
    total = like.agg(F.coalesce(F.sum(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))), F.lit(0.0)).alias("total"))
    themes = sizes.agg(F.count("*").alias("themes"))
    spread = per_record.agg(F.count("*").alias("clustered"), F.count_if(F.size("t") > 1).alias("several"))
    one = total.join(themes, F.lit(True)).join(spread, F.lit(True))  # three single rows
    pairs = F.col("themes") * (F.col("themes") - 1) / 2
    per_eligible = lambda x: F.lit(None).cast("double") if eligible == 0 else x / float(eligible)
    return one.select(
        per_eligible(F.col("clustered")).alias("coverage"),
        per_eligible(F.lit(float(outliers))).alias("outlier_rate"),
        F.when(pairs > 0, F.col("total") / pairs).otherwise(0.0).alias("mean_overlap"),
        F.when(F.col("clustered") > 0, F.col("several") / F.col("clustered")).otherwise(0.0).alias("multi_theme_share"),
    )


def set_counters(members: DataFrame, outliers: int) -> DataFrame:
    n = members.agg(F.countDistinct("record_id").alias("clustered"), F.countDistinct("theme_id").alias("themes"))
    return n.select("clustered", F.lit(outliers).cast("long").alias("outliers"), "themes", F.when(F.col("themes") == 0, "rejected").otherwise("ready_for_review").alias("status"))


def tags(members: DataFrame, labels: DataFrame, most: int = TAGS) -> DataFrame:
    """(theme_id, dimension, label, records, place): by theme, the labels (record_id, dimension, label) that most records have."""
    counts = members.select("theme_id", "record_id").join(labels, "record_id").groupBy("theme_id", "dimension", "label").agg(F.countDistinct("record_id").alias("records"))
    by = Window.partitionBy("theme_id").orderBy(F.desc("records"), "dimension", "label")
    return counts.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def theme_list(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc_nulls_last("opportunity_score"), "theme_id")
