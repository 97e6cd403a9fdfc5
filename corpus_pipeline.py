"""A training-corpus pipeline: reject toxic documents, drop near-duplicates, mask secrets, mix sources, encode.

Part of the subpackage feedloom.llm. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; it is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, mixing, near_copies, secrets, toxicity
from feedloom.llm.queries import tokenizer
from feedloom.llm.shared import read, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the grade model, fitted on the labels, doesn't reject."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    graded = toxicity.graded(docs.select(*COLUMNS), model, list(COLUMNS))
    return graded.where(~F.col("toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies (five-word shingles, similarity 0.8 or more): that of least doc_id, and among different texts of one id the one of least text hash. Rows without an id stay."""
    kept = near_copies.near_copies(docs).where("kept").select("doc_id", F.col("h").alias("_h"))
    known = docs.where("doc_id is not null").select(*COLUMNS, F.xxhash64("text").alias("_h"))
    # equal rows meet before the shuffle, which the join then shares
    once = known.groupBy("doc_id", "_h").agg(*(F.first(c).alias(c) for c in COLUMNS if c != "doc_id"))
    return once.join(kept, ["doc_id", "_h"]).select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; n_chars follows the text."""
    found = secrets.found(docs.select(*COLUMNS))
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, the files and the rows in them in the order that the schedule gives."""
    mixed = mixing.mixed(docs.select(*COLUMNS))
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with their number, and the number of code points and the hash of the text that they decode to."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models and hashes aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again; returns the last one's rows."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
