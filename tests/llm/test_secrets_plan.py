"""The secret scans' plan, which the driver holds and walks over and over."""

from feedloom.llm import secrets


def test_plan_stays_small(spark):
    docs = spark.createDataFrame([(1, "token=abcdefghijkl0 x")], "doc_id long, text string")
    plan = secrets.found(docs, {301: 2})._jdf.queryExecution().analyzed()
    # 0.6 million characters; 8 million while each p-value stood in it as often as it was used
    assert len(plan.toJSON()) < 1_000_000


def test_degenerate_tokens(spark):
    """Values that don't vary and all-low or all-high ones have no deviation to judge; they count as surely not random, without an error."""
    texts = ["a" * 19 + "1", "a1" + "=" * 30, "1a" * 12, "z" * 12 + "0" * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels = {r["doc_id"]: r["tested"][0]["level"] for r in secrets._candidates(docs).collect()}
    assert set(levels) == {0, 1, 2, 3} and levels[0] >= 8 and levels[2] >= 8 and levels[3] >= 8
