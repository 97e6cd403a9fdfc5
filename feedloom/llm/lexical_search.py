"""Ranked lexical search over ranges of documents.

The index has a row for each range: the ids and lengths of its documents and its terms' postings. A search gives each
term of a question, in each range, a tree of maxima: leaves are the term's contributions to the documents' scores, a node
holds the largest of the leaves below. What the question's terms have at a node adds up to a bound for every document there.
Nodes are opened from the highest bound on until the documents found are as many as asked for and no node's bound
reaches the last one's score; nodes whose bound equals it are opened too, as equal scores go by id.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.shared import batches_of, mapped, slices, written
from feedloom.llm.terms import alphabet, pieces

#: Documents, and about how many terms with repeats, that a range has at most; a longer document is a range of its own.
RANGE_DOCS, RANGE_TERMS = 4_096, 1 << 19
#: Readers and writers of Parquet hold a row group whole. By default its size is first looked at after 100 rows, which are 100 ranges here.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}
#: Children of a node.
FAN = 16
#: Characters of the questions that are searched for together, about.
BLOCK = 1 << 22
#: Trees that a task keeps for the next questions of a range.
TREES = 1_024
#: Ranges of a batch that a task holds at once; a range is large.
BATCH = 4
WORDS = alphabet(digits=True)
#: Lists are bytes: ids and lengths of 8 each, terms joined by blanks, first of 8 each, docs of 2 each, tfs of as many each as the largest needs.
INDEX = "ids binary, lengths binary, filled long, tokens long, terms binary, first binary, docs binary, tfs binary"
INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]
#: Stands for a null doc_id, which comes first among equals.
NO_ID = -(1 << 63)


def indexed(documents: DataFrame) -> DataFrame:
    """A row for each range of ``documents`` (doc_id, text): lengths of its documents and, term by term, postings from ``first`` on. No shuffle: a range is what one task reads together."""

    def row(ids: list, lengths: list, vocabulary: dict[bytes, int], terms: list, docs: list, tfs: list) -> pd.DataFrame:
        by = np.concatenate(terms) if terms else np.empty(0, np.int64)
        order = np.argsort(by, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(by, minlength=len(vocabulary)))]).astype(np.int64)
        pick = lambda parts: (np.concatenate(parts) if parts else np.empty(0, np.int64))[order]
        tf = pick(tfs)
        packed = {"ids": np.array(ids, np.int64), "lengths": np.array(lengths, np.int64), "first": first, "docs": pick(docs).astype(np.uint16), "tfs": tf.astype(np.min_scalar_type(tf.max(initial=0)))}
        return pd.DataFrame({"filled": [sum(n > 0 for n in lengths)], "tokens": [sum(lengths)], "terms": [b" ".join(vocabulary)]} | {k: [x.tobytes()] for k, x in packed.items()})[INDEX_COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh = lambda: ([], [], {}, [], [], [])
        now, tokens = fresh(), 0
        for part in slices(batches, "text"):
            for doc_id, text in zip(part["doc_id"], part["text"]):
                ids, lengths, vocabulary, terms, docs, tfs = now
                counts: Counter = Counter()
                for words in pieces(text, WORDS):
                    counts.update(words)
                own = [vocabulary.setdefault(w, len(vocabulary)) for w in counts]
                terms.append(np.array(own, np.int32))
                docs.append(np.full(len(own), len(ids), np.int32))
                tfs.append(np.fromiter(counts.values(), np.int64, len(own)))
                ids.append(int(doc_id))
                lengths.append(counts.total())
                tokens += lengths[-1]
                if len(ids) == RANGE_DOCS or tokens >= RANGE_TERMS:
                    yield row(*now)
                    now, tokens = fresh(), 0
        if now[0]:
            yield row(*now)

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    return mapped(documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text), run, INDEX)


def stored(documents: DataFrame) -> DataFrame:
    """The index as a table, of which a task holds a few ranges at once, however many it reads or writes."""
    return written(indexed(documents), **ROW_GROUPS)


def names(terms: bytes) -> list[str]:
    """The terms of a row of the index."""
    return terms.decode("utf-8", "replace").split(" ") if terms else []


def unpacked(row: pd.Series) -> dict:
    """A row of the index with lists in place of bytes."""
    docs = np.frombuffer(row["docs"], np.uint16)
    wide = len(row["tfs"]) // max(1, len(docs)) or 1
    longs = {c: np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "first")}
    return longs | {"terms": names(row["terms"]), "docs": docs, "tfs": np.frombuffer(row["tfs"], f"u{wide}")}


@dataclass
class Question:
    """An item's id and its terms with their repeats."""

    item: int | None
    terms: dict[str, int]


def questions(items: DataFrame) -> Iterator[list[Question]]:
    """The different items (item_id, text) by blocks of bounded size."""
    read = items.where("text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    blocks = max(1, -(-(read.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    for b in range(blocks):
        rows = read.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = [Question(r["item_id"], dict(Counter(w.decode() for part in pieces(r["text"].encode(), WORDS) for w in part))) for r in rows]
        if found := [q for q in found if q.terms]:
            yield found


def document_frequencies(index: DataFrame, terms: set[str]) -> dict[str, int]:
    """In how many documents each of the ``terms``, a block's, stands."""
    asked = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for terms, first in zip(batch["terms"], batch["first"]):
                counts.update({t: int(n) for t, n in zip(names(terms), np.diff(np.frombuffer(first, np.int64))) if t in asked.value})
        if counts:
            yield pd.DataFrame({"term": list(counts), "df": list(counts.values())})

    rows = index.select("terms", "first").mapInPandas(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}  # a row for each term of the block at most


class Range:
    """A range's postings of the asked terms, with their trees of maxima; ``weights``: each asked term's w."""

    def __init__(self, row: dict, weights: dict[str, int], filled: int, tokens: int):
        self.ids, self.weights = np.asarray(row["ids"], np.int64), weights
        self.m = np.array([75 + (25 * int(n) * filled) // tokens for n in row["lengths"]], np.int64)
        first = row["first"]
        self.at = {t: (first[k], first[k + 1]) for k, t in enumerate(row["terms"]) if t in weights}
        self.docs, self.tfs = row["docs"], row["tfs"]
        sizes = [-(-len(self.ids) // FAN) * FAN]
        while sizes[-1] > FAN:
            sizes.append(-(-sizes[-1] // FAN // FAN) * FAN)
        self.sizes = [*sizes, 1]
        self.trees: dict[str, list[np.ndarray]] = {}

    def tree(self, term: str) -> list[np.ndarray]:
        """From the leaves to the root, the term's largest contribution below each node."""
        if term not in self.trees:
            if len(self.trees) >= TREES:
                self.trees.pop(next(iter(self.trees)))
            a, b = self.at[term]
            docs, tf = self.docs[a:b], self.tfs[a:b].astype(np.int64)
            level = np.zeros(self.sizes[0], np.int64)
            level[docs] = self.weights[term] * ((1_000_000_000 * tf) // (1_000 * tf + 12 * self.m[docs]))
            levels = [level]
            for size in self.sizes[1:]:
                up = level.reshape(-1, FAN).max(1)
                level = np.zeros(size, np.int64)
                level[: len(up)] = up
                levels.append(level)
            self.trees[term] = levels
        return self.trees[term]

    def best(self, terms: dict[str, int], most: int, floor: int) -> tuple[list[tuple[int, int]], int]:
        """(score, id) of the ``most`` best documents of score ``floor`` or more, equal scores by id, and how many nodes were opened."""
        own = [t for t in terms if t in self.at]
        if not own:
            return [], 0
        times = np.array([[terms[t]] for t in own], np.int64)
        levels = [np.stack(x) for x in zip(*(self.tree(t) for t in own))]
        bounds = lambda k, a, b: (levels[k][:, a:b] * times).sum(0)
        open_nodes = [(-int(bounds(len(levels) - 1, 0, 1)[0]), len(levels) - 1, 0)]
        found: list[tuple[int, int]] = []
        opened = 0
        while open_nodes and -open_nodes[0][0] >= floor:
            bound, level, k = heapq.heappop(open_nodes)
            if level == 0:
                found.append((-bound, int(self.ids[k])))
                if len(found) == most:
                    floor = max(floor, -bound)
                continue
            opened += 1
            below = bounds(level - 1, k * FAN, (k + 1) * FAN)
            for j in np.flatnonzero(below >= floor):
                heapq.heappush(open_nodes, (-int(below[j]), level - 1, k * FAN + int(j)))
        return sorted(found, key=lambda x: (-x[0], x[1]))[:most], opened


def _searched(index: DataFrame, block: list[Question], filled: int, tokens: int, most: int) -> DataFrame:
    df = document_frequencies(index, {t for q in block for t in q.terms})
    weights = {t: math.floor(1000 * math.log((2 * filled + 2) / (2 * n + 1))) for t, n in df.items()}
    shared = index.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, w = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for batch in batches:
            for _, row in batch.iterrows():
                part = Range(unpacked(row), w, filled, tokens)
                for n, q in enumerate(asked):
                    # what the task found in earlier ranges bounds what can still count
                    floor = best[n][-1][0] if len(best[n]) == most else 1
                    more, _ = part.best(q.terms, most, floor)
                    best[n] = sorted(best[n] + more, key=lambda x: (-x[0], x[1]))[:most]
        rows = [(q.item, doc_id, score) for q, own in zip(asked, best) for score, doc_id in own]
        yield pd.DataFrame(rows, columns=["item_id", "doc_id", "score"]).astype({"item_id": "Int64", "doc_id": "int64", "score": "int64"})

    found = index.mapInPandas(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def searched(documents: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of ``items`` (item_id, text) the ``most`` documents of highest score above 0.

    Equal scores go by ascending doc_id, null ids first. Null and empty texts of documents hold no term; repeated rows are
    documents of their own. Items without terms have no rows; of several texts of one item_id the least counts; a null
    item_id is an item too. Without documents, without terms in them or without items there are no rows. Other columns are ignored.
    """
    index = stored(documents)
    filled, tokens = index.agg(F.sum("filled"), F.sum("tokens")).first()
    if not tokens:
        return index.select(F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    with batches_of(index.sparkSession, BATCH):
        parts = [written(_searched(index, block, filled, tokens, most)) for block in questions(items.select("item_id", "text"))]
    if not parts:
        return index.select(F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = reduce(DataFrame.unionByName, parts)
    return found.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
