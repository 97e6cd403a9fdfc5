"""Landed items of hosted collectors (JSON lines) to the raw-item schema, one projection for each source."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import author_hash, non_negative
from feedloom.operators.ingest import latest
from feedloom.sources.web import plain

# Source key, connector type and the record type that it lands; and the fields of the collectors' items.
REGISTRY = (
    ("google_play", "library", "app_review"), ("public_web", "http", "article_passage"), ("apple_app_store", "direct_api", "app_review"), ("reddit", "hosted_actor", "forum_post"),
    ("twitter", "hosted_actor", "social_post"), ("instagram", "hosted_actor", "social_post"), ("forum", "http", "forum_post"), ("mouthshut", "http", "product_review"), ("quickcommerce", "rss", "article_passage"),
)
_MEDIA = "array<struct<type:string,media_url_https:string,media_url:string,video_info:struct<variants:array<struct<content_type:string,bitrate:long,url:string>>>>>"
SCHEMAS = {
    "reddit": "id string, dataType string, createdAt string, url string, title string, body string, username string, communityName string, imageUrls array<string>, videoUrls array<string>",
    "twitter": f"id string, text string, createdAt string, inReplyToId string, twitterUrl string, url string, lang string, likeCount long, replyCount long, retweetCount long, viewCount long, isReply boolean, author struct<userName:string>, extendedEntities struct<media:{_MEDIA}>, media {_MEDIA}",
    "instagram": "id string, shortCode string, timestamp string, caption string, url string, ownerUsername string, likesCount long, commentsCount long, videoUrl string, displayUrl string, hashtags array<string>, type string",
    "google_play": "reviewId string, at timestamp_ntz, content string, score int, userName string, thumbsUpCount long, appVersion string, replyContent string",
    "apple_app_store": "id string, updated string, content string, title string, rating int, author string, version string, voteSum string, voteCount string",
    "quickcommerce": "link string, title string, summary string, published string, author string, feedUrl string",
}
#: The raw item, whatever its source.
ITEM = (
    "external_id string, record_type string, body string, external_parent_id string, source_url string, published_at timestamp, edited_at timestamp, title string, author_hash string, rating double, rating_scale double, "
    "engagement_count long, reply_count long, language_hint string, country_code string, app_version string, media_url string, media_type string, metadata map<string,string>"
)
# Fixed value: the social collector's time format.
SOCIAL_TIME = "EEE MMM dd HH:mm:ss Z yyyy"


@dataclass(frozen=True)
class CollectionConfig:
    target: str
    limit: int | None = None
    date_from: date | None = None
    date_to: date | None = None

    def problems(self) -> list[str]:
        out = [] if self.target.strip() else ["blank target"]
        if self.limit is not None and self.limit <= 0:
            out.append("limit must be positive")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            out.append("dates are inverted")
        return out


def landed(spark: SparkSession, source: str, path: str) -> DataFrame:
    """The source's landed JSON under its schema; lines that don't parse land as nulls and fall out of the projections."""
    return spark.read.schema(SCHEMAS[source]).json(path)


def parsed(lines: DataFrame, source: str, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, SCHEMAS[source]).alias("x")).select("x.*")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "source_key string, connector_type string, record_type string")


def _item(df: DataFrame, **columns: Column) -> DataFrame:
    """Raw items with all columns of ITEM, in its order; null where the source tells nothing."""
    fields = (f.strip().split(" ", 1) for f in ITEM.split(", "))
    return df.select(*(columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in fields))


def _told(**values: Column) -> Column:
    """A map of what the source tells beside the columns; what is null is left out."""
    known = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(known, lambda k, v: v.isNotNull())


def _filled(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def forum_items(df: DataFrame) -> DataFrame:
    comment = F.col("dataType") == "comment"
    post = F.regexp_extract(F.coalesce("url", F.lit("")), "/comments/([a-z0-9]+)/", 1)
    return _item(
        df.where(F.col("dataType").isin("post", "comment")),
        external_id=F.col("id"),
        external_parent_id=F.when(comment & (post != ""), F.concat(F.lit("t3_"), post)),
        record_type=F.when(comment, "forum_comment").otherwise("forum_post"),
        title=F.col("title"),
        body=F.col("body"),
        source_url=F.col("url"),
        published_at=F.try_to_timestamp("createdAt"),
        author_hash=author_hash(F.col("username")),
        metadata=_told(community_name=F.col("communityName")),
        media_url=F.coalesce(F.get("videoUrls", F.lit(0)), F.get("imageUrls", F.lit(0))),
        media_type=F.when(F.size("videoUrls") > 0, "video").when(F.size("imageUrls") > 0, "image"),
    )


def social_items(df: DataFrame) -> DataFrame:
    listed = F.when(F.size(F.col("extendedEntities.media")) > 0, F.col("extendedEntities.media")).otherwise(F.col("media"))
    first = F.get(listed, F.lit(0))
    variants = first["video_info"]["variants"]
    films = F.filter(variants, lambda v: v["content_type"] == "video/mp4")
    # the first of the highest bitrate: a smaller place wins among equals
    best = F.array_max(F.transform(films, lambda v, i: F.struct(F.coalesce(v["bitrate"], F.lit(0).cast("long")).alias("rate"), (-i).alias("at"), v["url"].alias("url"))))["url"]
    film = first["type"].isin("video", "animated_gif")
    url = F.when(first["type"] == "photo", F.coalesce(F.when(first["media_url_https"] != "", first["media_url_https"]), first["media_url"])).when(film, F.coalesce(best, F.get(variants, F.lit(0))["url"]))
    return _item(
        df.where("id is not null and text is not null"),
        external_id=F.col("id"),
        external_parent_id=F.col("inReplyToId"),
        record_type=F.lit("social_post"),
        body=F.col("text"),
        source_url=F.coalesce(_filled("twitterUrl"), F.col("url")),
        language_hint=F.col("lang"),
        metadata=_told(retweet_count=F.col("retweetCount"), view_count=F.col("viewCount"), is_reply=F.col("isReply")),
        published_at=F.try_to_timestamp(F.substring("createdAt", 5, 100), F.lit(SOCIAL_TIME.removeprefix("EEE "))),
        author_hash=author_hash(F.col("author.userName")),
        engagement_count=non_negative(F.col("likeCount")),
        reply_count=non_negative(F.col("replyCount")),
        media_url=url,
        media_type=F.when(first["type"] == "photo", "image").when(film & (F.size(variants) > 0), "video"),
    )


def hashtag_items(df: DataFrame) -> DataFrame:
    post = F.coalesce(_filled("id"), _filled("shortCode"))
    film, still = _filled("videoUrl"), _filled("displayUrl")
    return _item(
        df.where(post.isNotNull()),
        external_id=post,
        record_type=F.lit("social_post"),
        body=F.col("caption"),
        source_url=F.col("url"),
        metadata=_told(hashtags=F.to_json("hashtags"), post_type=F.col("type")),
        published_at=F.try_to_timestamp("timestamp"),
        author_hash=author_hash(F.col("ownerUsername")),
        engagement_count=non_negative(F.col("likesCount")),
        reply_count=non_negative(F.col("commentsCount")),
        media_url=F.coalesce(film, still),
        media_type=F.when(film.isNotNull(), "video").when(still.isNotNull(), "image"),
    )


def token_reviews(df: DataFrame, app: str = "", language: str | None = None, country: str = "") -> DataFrame:
    """Reviews by token, of one app's store in one language and country. Times without a zone are UTC; ratings are out of five."""
    return _item(
        df.where("reviewId is not null"),
        external_id=F.col("reviewId"),
        record_type=F.lit("app_review"),
        body=F.col("content"),
        source_url=F.concat(F.lit(f"https://play.google.com/store/apps/details?id={app}&reviewId="), F.col("reviewId")),
        published_at=F.col("at"),
        rating=F.col("score"),
        rating_scale=F.lit(5.0),
        author_hash=author_hash(F.col("userName")),
        engagement_count=F.col("thumbsUpCount"),
        language_hint=F.lit(language),
        country_code=F.lit(country.upper()[:2] or None),
        app_version=F.col("appVersion"),
        metadata=_told(has_developer_reply=F.coalesce(F.col("replyContent") != "", F.lit(False))),
    )


def paged_reviews(df: DataFrame, app: str = "", country: str = "") -> DataFrame:
    """Reviews by page. Entries without a rating describe the app itself and fall out."""
    return _item(
        df.where("rating is not null"),
        external_id=F.coalesce("id", F.lit("")),
        record_type=F.lit("app_review"),
        title=F.col("title"),
        body=F.col("content"),
        source_url=F.lit(f"https://itunes.apple.com/{country}/review?id={app}&type=Purple%20Software"),
        published_at=F.try_to_timestamp("updated"),
        rating=F.when(F.col("rating") != 0, F.col("rating")),
        rating_scale=F.lit(5.0),
        author_hash=author_hash(F.col("author")),
        app_version=F.col("version"),
        country_code=F.lit(country.upper()[:2] or None),
        metadata=_told(vote_sum=F.col("voteSum"), vote_count=F.col("voteCount")),
    )


def feed_articles(df: DataFrame) -> DataFrame:
    """Feed entries with a link; the summary's markup is taken off."""
    return _item(
        df.where("link is not null and link != ''"),
        external_id=F.sha2("link", 256),
        record_type=F.lit("article_passage"),
        title=_filled("title"),
        body=plain("summary"),
        source_url=F.col("link"),
        published_at=F.try_to_timestamp("published"),
        metadata=_told(feed_url=F.col("feedUrl"), author_display_name=_filled("author")),
    )


PROJECTIONS = {"reddit": forum_items, "twitter": social_items, "instagram": hashtag_items, "google_play": token_reviews, "apple_app_store": paged_reviews, "quickcommerce": feed_articles}


def past_mark(entries: DataFrame, marks: DataFrame, feed: str, at: str) -> DataFrame:
    """Entries newer than their feed's mark, or without a time. marks (feed, mark): one row for each feed."""
    joined = entries.join(marks.select(F.col(feed), F.col("mark").alias("_mark")), feed, "left")
    return joined.where(F.col(at).isNull() | F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).drop("_mark")


def new_marks(entries: DataFrame, marks: DataFrame, feed: str, at: str) -> DataFrame:
    seen = entries.groupBy(feed).agg(F.max(at).alias("_seen"))
    return marks.join(seen, feed, "full_outer").select(feed, F.greatest("mark", "_seen").alias("mark"))


def error_class(status: Column, challenge: Column | None = None, safe: Column | None = None, configured: Column | None = None) -> Column:
    """struct(error, retryable) of a fetch: its HTTP status (null: no answer came), whether a challenge came back,
    whether the URL is a public one, and whether the source is set up at all; null where nothing went wrong."""
    yes = lambda c, default: F.lit(default) if c is None else F.coalesce(c, F.lit(default))
    kind = (
        F.when(~yes(configured, True), "config")
        .when(~yes(safe, True), "ssrf_blocked")
        .when(status.isNull(), "transient")
        .when(status == 429, "rate_limited")
        .when(status.isin(401, 403), "auth")
        .when(status.between(500, 599), "transient")
        .when(status >= 400, "unavailable")
        .when(yes(challenge, False), "blocked_content")
    )
    return F.struct(kind.alias("error"), F.coalesce(kind.isin("rate_limited", "transient"), F.lit(False)).alias("retryable"))


def collected(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of one collection, fetched: ITEM's columns and at, the place in the order of arrival, with error, null where the item came whole.

    A broken item is put aside and doesn't stop the others; what came before a fetch that broke off stays. An item needs an
    external_id and a record_type; of an id that comes twice the last counts.
    """
    broken = F.coalesce("error", F.when(F.coalesce("external_id", F.lit("")) == "", "missing_id").when(F.col("record_type").isNull(), "missing_type"))
    judged = fetched.withColumn("error", broken)
    good = judged.where("error is null").drop("error")
    return latest(good, ["external_id"], "at"), judged.where("error is not null")
