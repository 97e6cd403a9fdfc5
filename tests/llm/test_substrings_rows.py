"""Rows without an id, or with one that others have, are documents of their own; passages in very many documents."""

import random

import brute
import pytest

from feedloom.llm import substrings


def test_rows_of_one_key_lose_their_own_words_only(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    other = " ".join(f"clean{i}" for i in range(60))
    texts = [(None, passage), (None, passage), (None, other), (7, other + " end"), (7, passage + " tail"), (7, "short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removed(docs).collect())
    kept = [(True, passage, 0), (True, "", 30), (True, other, 0), (False, "end", 60), (False, "tail", 30), (False, "short", 0)]
    assert got == sorted((null, len(k.split()) + gone, gone, brute.sha(k)) for null, k, gone in kept)


def test_a_text_that_stands_nowhere_else_stays(spark):
    passage, rest = (" ".join(f"{w}{i}" for i in range(40)) for w in ("p", "r"))
    docs = spark.createDataFrame([(1, passage), (2, passage), (2, rest)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.removed(docs).collect()) == [(1, 0), (2, 0), (2, 40)]


@pytest.mark.parametrize("hot", [3, 1_000])
def test_passages_in_many_documents(spark, monkeypatch, hot):
    """With a low bound every way is taken: the shards, the copies and the single windows."""
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(3)
    passages = [" ".join(f"{rng.randrange(400)}" for _ in range(rng.randrange(22, 60))) for _ in range(5)]
    filler = lambda n: " ".join(f"{rng.randrange(60)}" for _ in range(n))
    texts = [f"{filler(rng.randrange(12))} {rng.choice(passages)} {filler(rng.randrange(30))} {rng.choice(passages)} {filler(3)}" for _ in range(80)]
    docs = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts[:20])), (300, " ".join(["same"] * 90))]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(brute.removed_rows(docs))
