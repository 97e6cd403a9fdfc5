"""The pipeline's stages on their own inputs, and the chain."""

import re

import brute
import pandas as pd
from test_near_copies import roots
from test_operators import TELLING

import corpus_pipeline as pipeline

SMALL = "/root/testdata/sf0.01"


def test_chain(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash near-dedup", "secret scans", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = pd.read_parquet(f"{SMALL}/labels.parquet")
    kept = pipeline.reject_toxic(spark, docs, SMALL)
    assert kept.columns == list(pipeline.COLUMNS)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    toxic = set(labels.loc[labels["toxic"] == 1, "doc_id"])
    clean = set(labels.loc[labels["toxic"] == 0, "doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    telling = {i for i in toxic if re.search(TELLING, texts[i])}
    assert telling and len(telling - ids) >= 0.95 * len(telling) and len(clean & ids) >= 0.98 * len(clean)

    unique = pipeline.drop_near_duplicates(spark, kept, SMALL)
    left = {r["doc_id"] for r in unique.select("doc_id").collect()}
    assert left == roots([(r["doc_id"], r["text"]) for r in kept.collect()])

    masked = pipeline.mask_secrets(spark, unique, SMALL).collect()
    assert {r["doc_id"] for r in masked} == left and all(not brute.secrets_base(r["text"]) and r["n_chars"] == len(r["text"]) for r in masked)
    mixed = pipeline.mix_sources(spark, unique, SMALL)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(left) and mixed.columns == list(pipeline.COLUMNS)
    whole = pipeline.run(spark, SMALL).toPandas()
    assert set(whole["doc_id"]) == left and (whole["n_tokens"] == whole["ids"].map(len)).all()


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "x y z w", None, None, 7), (2, None, None, "s", 0), (3, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[1:]:
        docs = stage(spark, docs, SMALL)
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in docs.collect())
    assert [x[:2] for x in found] == [(False, 1), (False, 2), (True, 0)]


def test_different_texts_of_one_id_are_different_documents(spark):
    words = " ".join(f"w{n}" for n in range(40))
    rows = [(1, "a b c d e f"), (1, words), (2, words), (3, "q r s t u v")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [(1, "a b c d e f"), (1, words), (3, "q r s t u v")]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, h string, kept string, slot string, base string, _h string")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
