"""Small literal cases of rules that no table of the fixtures shows."""

import pytest
from pyspark.sql import functions as F

from feedloom.functions import privacy, text
from feedloom.operators import evaluation, insights, taxonomy
from feedloom.operators import themes as th
from feedloom.sources import landing, web


def one(spark, column, **values):
    names = ", ".join(f"{n} string" for n in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("x",)], names).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("given", "want"), [("  hello   world  ", "hello world"), ("a\n\n\n\n\nb", "a\n\nb"), ("hello\x00\x07world", "helloworld"), (None, ""), ("", ""), (" \t\n ", ""), ("été नमस्ते", "été नमस्ते"), ("　x ", "x")])
def test_normalized(spark, given, want):
    assert one(spark, text.normalized(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("given", "want", "kinds"),
    [
        ("mail jane@example.com now", "mail [EMAIL] now", ["email"]),
        ("call 9876543210 today", "call [PHONE] today", ["phone"]),
        ("pay rahul123@ybl please", "pay [PAYMENT_ID] please", ["payment_identifier"]),
        ("order id: AB12CD34 is late", "order id: [ORDER_ID] is late", ["order_id"]),
        ("nothing of the kind", "nothing of the kind", []),
        ("", "", []),
    ],
)
def test_redacted(spark, given, want, kinds):
    got = one(spark, privacy.redacted(F.col("t")), t=given)
    assert got["redacted"] == want and [e["type"] for e in got["events"]] == kinds


@pytest.mark.parametrize(("given", "want"), [("", "insufficient_content"), ("https://a.org/b", "insufficient_content"), ("Click here to WIN a prize", "spam_or_promotion"), ("an ordinary text", "unreviewed")])
def test_relevance(spark, given, want):
    assert one(spark, text.relevance(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("original", "normal", "code", "want"),
    [("\x00", "", None, "malformed"), ("bonjour tout le monde", "bonjour tout le monde", "fr", "unsupported_language"), ("short", "short", None, "low_information"), ("a text that is long enough", "a text that is long enough", "en", "usable")],
)
def test_quality(spark, original, normal, code, want):
    lang = text.language(F.col("n"), F.col("c"))
    assert one(spark, text.quality(F.col("o"), F.col("n"), lang), o=original, n=normal, c=code) == want


def test_opportunity_score(spark):
    members = spark.createDataFrame([(1, n, "a", "2024-12-30", 0.85, False) for n in range(4)], "theme_id long, record_id long, connector string, published_at string, membership_score double, is_counterexample boolean").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    themes = spark.createDataFrame([(1, "exploration_barrier", 0.7), (2, "service_quality", 1.7)], "theme_id long, theme_type string, confidence double")
    severities = spark.createDataFrame([(0, 4), (1, 4), (2, 3), (3, None)], "record_id long, severity int")
    got = {r["theme_id"]: r for r in th.metrics(members, themes, severities, 4, 1, "2024-12-31").collect()}
    assert round(got[1]["opportunity_score"], 6) == 87.366667 and got[2]["components"]["confidence"] == 1.0 and got[2]["components"]["discovery_relevance"] == 0.5


def test_ranks_of_a_theme_over_many_parts(spark):
    rows = [(n % 2, n, (n * 7 % 50) / 50) for n in range(400)]
    got = th.ranked(spark.createDataFrame(rows, "theme_id long, record_id long, membership_score double")).collect()
    for theme in (0, 1):
        order = sorted((-s, i) for t, i, s in rows if t == theme)
        assert [(r["record_id"], r["rank"]) for r in sorted((r for r in got if r["theme_id"] == theme), key=lambda r: r["rank"])] == [(i, k) for k, (_, i) in enumerate(order, 1)]


@pytest.mark.parametrize(
    ("metrics", "status"),
    [
        ({"citation_integrity_hard_failure_count": 0.0, "citation_integrity_pass_rate": 1.0}, "pass"), ({"citation_integrity_hard_failure_count": 1.0}, "fail"), ({"unsupported_label_pass_rate": 0.9}, "fail"),
        ({"causal_overclaim_pass_rate": 0.5}, "pass_with_conditions"), ({}, "pass"), ({"causal_overclaim_pass_rate": 0.5, "unsupported_label_pass_rate": 0.9}, "fail"),
    ],
)
def test_release_gate(spark, metrics, status):
    frame = spark.createDataFrame(list(metrics.items()), "metric_key string, numeric_value double")
    assert evaluation.release_gate(frame).first()["status"] == status


def test_citation_integrity(spark):
    answers = spark.createDataFrame([("good", [["a"], ["b"]], 2), ("invented", [["a", "z"]], 2), ("miscounted", [["a"], []], 5), ("empty", [], 0)], "object_id string, findings array<array<string>>, citation_count int")
    known = spark.createDataFrame([("a",), ("b",)], "cited_id string")
    got = {r["object_id"]: (r["passed"], r["score"], r["hard_failure"]) for r in evaluation.citation_integrity(answers, known).collect()}
    assert got == {"good": (True, 1.0, False), "invented": (False, 1.0, True), "miscounted": (False, 0.5, False), "empty": (True, 1.0, False)}


def test_social_media_items(spark):
    line = '{"id": "1", "text": "t", "twitterUrl": "u", "lang": "en", "likeCount": -1, "createdAt": "Mon Jan 01 10:00:00 +0000 2024", "author": {"userName": "a"}, "extendedEntities": {"media": [{"type": "video", "video_info": {"variants": [{"content_type": "video/mp4", "bitrate": 1, "url": "low"}, {"content_type": "video/mp4", "bitrate": 9, "url": "high"}]}}]}, "media": [{"type": "photo", "media_url": "p"}]}'
    got = landing.social_items(landing.parsed(spark.createDataFrame([(line,)], "value string"), "twitter")).first()
    assert (got["media_url"], got["media_type"], got["source_url"], got["language_hint"], got["engagement_count"]) == ("high", "video", "u", "en", None)


def test_all_items_have_one_schema(spark):
    frames = [f(landing.parsed(spark.createDataFrame([("{}",)], "value string"), s)) for s, f in landing.PROJECTIONS.items()]
    assert len({f.schema.simpleString() for f in frames}) == 1


def test_collected_keeps_what_came(spark):
    item = ", ".join(f"cast(null as {kind}) as {n}" for n, kind in (f.strip().split(" ", 1) for f in landing.ITEM.split(", ")) if n not in ("external_id", "record_type", "body"))
    rows = spark.sql(f"select x.*, {item} from values ('a', 't', 'one', 1, null), ('a', 't', 'two', 2, null), (null, 't', 'x', 3, null), ('b', 't', 'y', 4, 'timeout') as x(external_id, record_type, body, at, error)")
    items, failures = landing.collected(rows)
    assert [(r["external_id"], r["body"]) for r in items.collect()] == [("a", "two")] and sorted(r["error"] for r in failures.collect()) == ["missing_id", "timeout"]


def test_taxonomy_text_and_answers(spark):
    rows = spark.createDataFrame(
        [("main", "Main", 1, 10, "m1", "def1", None, 1), ("main", "Main", 1, 11, "m2", "def2", None, 2), ("sub", "Sub", 2, 20, "s1", "def3", 10, 1)],
        "dimension string, display_name string, dimension_order int, label_id long, label string, definition string, parent_id long, place int",
    )
    assert taxonomy.rendered(rows).first()["text"] == "- main (Main):\n    - m1: def1\n        - s1: def3\n    - m2: def2"
    whole = '"sentiment_label": "positive", "sentiment_score": 0.5, "sentiment_confidence": 0.5, "severity_value": 2, "severity_confidence": 0.5, "summary": "s", "overall_confidence": 0.5'
    answers = ["{" + whole + "}", "{" + whole + ', "main": [{"label": "m1", "confidence": 0.5}]}', "{" + whole + ', "main": [{"label": "other", "confidence": 0.5}]}', "{" + whole.replace("2,", "9,") + "}", "{}"]
    got = taxonomy.checked_answers(spark.createDataFrame(list(enumerate(answers)), "n int, answer string"), {"main": ["m1", "m2"], "none": []})
    assert [r["problem"] for r in got.orderBy("n").collect()] == [None, None, "main", "severity_value", "sentiment_label"]


def test_insights(spark):
    themes = spark.createDataFrame([(1, "n", "s", 12.345, {"a": 1.0}), (2, "n", "s", None, None)], "theme_id long, name string, summary string, opportunity_score double, components map<string,double>")
    members = spark.createDataFrame([(1, 5, 1, True, False), (1, 6, 2, False, True)], "theme_id long, record_id long, rank int, is_representative boolean, is_counterexample boolean")
    records = spark.createDataFrame([(5, "five"), (6, "six")], "record_id long, redacted string")
    assert [tuple(r) for r in insights.prompts(themes, members, records, "{{THEME_NAME}} {{OPPORTUNITY_SCORE}} {{RECORD_COUNT}} {{UNTRUSTED_CONTENT}}").collect()] == [(1, "n 12.35 2 <untrusted>\n[1] five\n[counterexample] six\n</untrusted>")]
    answers = spark.createDataFrame(
        [(1, "synthesized_insight", "t", "elderly users", "i", "c", "p", "try", [(1, "supporting", 0.9), (0, "contradictory", 0.1), (7, "supporting", 0.5)])],
        "theme_id long, insight_type string, title string, finding string, interpretation string, affected_context string, product_implication string, recommendation string, citations array<struct<number:int,role:string,relevance:double>>",
    )
    made, evidence = insights.generated(themes, members, records, answers)
    got = made.first()
    assert got["finding"].startswith("[removed") and got["support_count"] == 1 and got["publishable"] and sorted(r["record_id"] for r in evidence.collect()) == [5, 6]


def test_challenge_and_list(spark):
    assert one(spark, web.challenged(F.col("t")), t='<div class="g-recaptcha">') and not one(spark, web.challenged(F.col("t")), t="<p>fine</p>")
    urls = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "url string, at int")
    assert [tuple(r) for r in web.listed(urls, 1).orderBy("index").collect()] == [("a", 1), ("c", 2)]
