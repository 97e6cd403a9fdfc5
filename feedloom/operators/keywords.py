"""Keyword search over stored postings: texts that hold all words of a question, ranked by their minimal covers.

A cover is an interval of words that holds every word of the question, and is minimal if no shorter one within it does. A
text's score is the sum of 1 / (words in the cover) over its minimal covers, each to nine decimals; equal scores go by record_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.storage import tabled

MOST = 40
#: Folders that the terms are dealt over; a search of few terms opens theirs only.
PARTS = 64
#: Postings that a task puts together before it hands them on.
ROWS = 50_000
SCALE = 1_000_000_000
POSTINGS = "term string, record_id long, places array<int>, part int"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def postings(records: DataFrame, parts: int = PARTS) -> DataFrame:
    """(term, record_id, places, part) of records (record_id, text): where each word stands, counted from 0, one row for each word of a text.

    A text is taken apart in the task that reads it: its words aren't shuffled. Rows without an id are left out; of rows that
    share one, each is a text of its own, so give each record once.
    """
    told = records.where("record_id is not null").select(F.col("record_id").cast("long").alias("record_id"), F.array_join(words(F.col("text")), " ").alias("words"))
    return told.mapInArrow(_placed, "term string, record_id long, places array<int>").select("term", "record_id", "places", _part(F.col("term"), parts).alias("part"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, record_id, places) of (record_id, words: put together by spaces), in batches of about ROWS rows."""
    terms, ids, counts, places = [], [], [], []

    def told() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.record_batch([pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places, pa.int32()))], ["term", "record_id", "places"])

    for batch in batches:
        for record_id, line in zip(batch["record_id"].to_pylist(), batch["words"]):
            found = {}
            for i, w in enumerate(line.as_py().split()):
                if w in found:
                    found[w].append(i)
                else:
                    found[w] = [i]
            terms += found
            ids += [record_id] * len(found)
            counts += map(len, found.values())
            places += chain.from_iterable(found.values())
            if len(terms) >= ROWS:
                yield told()
                terms, ids, counts, places = [], [], [], []
    if terms:
        yield told()


def write(records: DataFrame, path: str, parts: int = PARTS, splits: int = 8) -> None:
    """Adds the records' postings to those stored under ``path``; a part's rows are dealt over ``splits`` tasks by their text, fewer where the planner merges small ones.

    More records are added by writing them; the ones that are there stay as they are. One shuffle, whose
    largest piece is a split of a part: a word that every text has is one row for each text and goes to all splits of its part.
    """
    split = F.pmod(F.xxhash64("record_id"), F.lit(splits))
    dealt = postings(records, parts).repartition("part", split).sortWithinPartitions("part")
    dealt.write.mode("append").partitionBy("part").parquet(path, compression="zstd")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(path)


def _share(size: Column) -> Column:
    """SCALE over size, rounded down."""
    return ((SCALE - F.pmod(F.lit(SCALE), size)) / size).cast("long")


def _covered(held: Column, size: Column) -> Column:
    """The sum of 1 / words over the minimal covers, in units of 1 / SCALE. held: array of (place, n), sorted, n the word's number from 0; size: how many words there are."""
    nowhere = F.lit(-1)
    start = F.struct(F.transform(F.sequence(F.lit(1), size), lambda _: nowhere).alias("last"), nowhere.alias("left"), F.lit(0).cast("long").alias("sum"))

    def step(state: Column, x: Column) -> Column:
        last = F.transform(state["last"], lambda at, n: F.when(n == x["n"], x["place"]).otherwise(at))
        # the cover that ends here begins where the word seen longest ago stands; if an earlier one began there, it is within this one
        return F.transform(
            F.array(F.struct(last.alias("last"), F.array_min(last).alias("low"))),
            lambda s: F.struct(
                s["last"].alias("last"),
                F.greatest(state["left"], s["low"]).alias("left"),
                (state["sum"] + F.when(s["low"] > state["left"], _share(x["place"] - s["low"] + 1)).otherwise(F.lit(0))).cast("long").alias("sum"),
            ),
        )[0]

    return F.aggregate(held, start, step, lambda s: s["sum"])


def search(stock: DataFrame, questions: DataFrame, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(question_id, place, record_id, score) of questions (question_id, text): the ``most`` best texts that hold all of the question's words, of postings ``stock``.

    A question's rarest word finds the texts; of the others, only the postings of these texts are joined, by word and text, so
    no word's postings meet in one task. A question without words finds nothing, and ids that are null don't take part.
    """
    asked = questions.where("question_id is not null").select("question_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    asked = tabled(asked.distinct().withColumn("part", _part(F.col("term"), parts)))
    opened = [r["part"] for r in asked.select("part").distinct().collect()]  # as many as there are parts, at most
    # the asked words' postings are read thrice below, all others once
    mine = tabled(stock.where(F.col("part").isin(opened)).join(asked.select("term", "part").distinct(), ["part", "term"], "left_semi"))
    counts = mine.groupBy("term").agg(F.count("*").alias("texts"))
    by_question = Window.partitionBy("question_id").orderBy(F.coalesce("texts", F.lit(0)), "term")
    numbered = asked.join(counts, "term", "left").withColumn("n", F.row_number().over(by_question) - 1)
    numbered = tabled(numbered.withColumn("size", F.count("*").over(Window.partitionBy("question_id"))).select("question_id", "term", "part", "n", "size"))
    found = mine.join(numbered.where("n = 0").select("question_id", "term", "part", "size"), ["part", "term"]).select("question_id", "record_id", "size", "places")
    others = numbered.where("n > 0")
    wanted = found.select("question_id", "record_id").join(others, "question_id").join(mine, ["part", "term", "record_id"])
    held = found.select("question_id", "record_id", "size", F.lit(0).alias("n"), "places").unionByName(wanted.select("question_id", "record_id", "size", "n", "places"))
    spots = F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("place"), F.col("n").alias("n")))))
    whole = held.groupBy("question_id", "record_id").agg(F.first("size").cast("int").alias("size"), F.count("*").alias("words"), F.array_sort(spots).alias("held")).where("words = size")
    scored = whole.select("question_id", "record_id", (_covered(F.col("held"), F.col("size")) / SCALE).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "record_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("question_id", "place", "record_id", "score")
