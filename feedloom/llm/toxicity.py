"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.shared import checkpointed, mapped, slices

#: Bounds of the labelled sample that a model is fitted on, by label (documented parameters).
MOST_TOXIC, MOST_CLEAN = 4_000, 8_000
#: The least likelihood-ratio statistic of a feature of the model.
LEAST_EVIDENCE = 24.0
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
GRADES = 3
#: From which P(grade > 0) a text is rejected; texts without a telling feature stay far below.
REJECT_AT = 0.35
WORD = re.compile(r"\w+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


@dataclass(frozen=True)
class Model:
    """P(grade > k) = sigmoid(weights . x - cuts[k]), x being log(1 + count) of each feature."""

    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, counts: Counter) -> np.ndarray:
        """P(grade > k) for each cut k."""
        score = sum(self.weights[i] * np.log1p(n) for i, n in counts.items())
        return 1 / (1 + np.exp(self.cuts - score))


class Hits(dict):
    """word -> indices of its features; remembers up to ``most`` words."""

    def __init__(self, index: dict[str, int], most: int = 100_000):
        self.index, self.most = index, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = tuple(i for f in features_of(word) if (i := self.index.get(f)) is not None)
        return found

    def counts(self, text: str | None) -> Counter:
        return Counter(i for word in WORD.findall((text or "").lower()) for i in self[word])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight) of at most about MOST_TOXIC and MOST_CLEAN labelled documents, picked by a hash of the id; each text once.

    weight: how many labelled documents each stands for, 1 / the rate at which its label was picked.
    Labels other than 0 and 1, and null texts, are left out; of several labels of one document the higher counts.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    space = 1 << 30
    rates = [min(1, most / max(1, n.get(label, 0))) for label, most in enumerate((MOST_CLEAN, MOST_TOXIC))]
    by_label = lambda clean, toxic: F.when(F.col("toxic") == 1, toxic).otherwise(clean)
    cut = by_label(*(int(space * x) for x in rates))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < cut)
    texts = docs.where("text is not null").select("doc_id", "text")
    return texts.join(F.broadcast(picked), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic", by_label(*(1 / x for x in rates)).cast("double").alias("weight"))


def telling(sample: DataFrame) -> list[str]:
    """The features that stand in toxic texts far more often than chance has it, the most telling first.

    The test asks whether the shares within the two labels differ, so the rates at which these were picked don't matter to it,
    and it counts the texts that were seen, without their weights.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text", 2_000_000):
            seen = (Counter(), Counter())
            for text, toxic in zip(part["text"], part["toxic"]):
                seen[toxic].update({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"feature": names, "toxic": [seen[1][f] for f in names], "clean": [seen[0][f] for f in names]})

    n = sample.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    if not n["toxic"] or not n["clean"]:
        return []
    counts = mapped(sample, run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c, nt, nc = F.col("t"), F.col("c"), F.lit(float(n["toxic"])), F.lit(float(n["clean"]))
    share = (t + c) / (nt + nc)
    term = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    evidence = 2 * (term(t, nt * share) + term(c, nc * share) + term(nt - t, nt * (1 - share)) + term(nc - c, nc * (1 - share)))
    found = counts.withColumn("evidence", evidence).where((t / nt > c / nc) & (F.col("evidence") >= LEAST_EVIDENCE))
    return [r["feature"] for r in found.orderBy(F.desc("evidence"), "feature").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled documents, or None where one of the two labels is missing.

    Grades: 0 for texts labelled clean; toxic texts get 1, or 2 where they hold at least
    the toxic texts' median of telling features, counted as the model counts them. Only the sample's counts of the chosen
    features come to the driver, both bounded by this module's parameters.
    """
    sample = checkpointed(labelled_sample(docs, labels))
    names = telling(sample)
    if not names:
        return None
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = Hits(index)
        for part in slices(batches, "text"):
            counts = [hits.counts(t) for t in part["text"]]
            yield pd.DataFrame({"toxic": part["toxic"], "weight": part["weight"], "at": [list(c) for c in counts], "n": [list(c.values()) for c in counts]})

    rows = mapped(sample, run, "toxic int, weight double, at array<int>, n array<int>").collect()
    toxic = np.array([r["toxic"] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    col = np.array([i for r in rows for i in r["at"]], np.int64)
    value = np.log1p(np.array([n for r in rows for n in r["n"]], np.float64))
    amount = np.bincount(row, value, len(rows))
    grade = toxic * (1 + (amount >= np.median(amount[toxic == 1])))
    return Model(index, *ordinal(row, col, value, grade, len(names), np.array([r["weight"] for r in rows])))


def ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, weight: np.ndarray, ridge: float = 1e-5, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) of the proportional-odds model, by accelerated gradient steps on the ridge-penalised mean loss, each row counted by its weight.

    The cuts are a first one and positive gaps, so they stay in order; the weights are shared by all.
    """
    n, k = len(grade), GRADES - 1
    part = weight / weight.sum()
    weights, first, gaps = np.zeros(width), 0.0, np.zeros(k - 1)
    moments = [np.zeros(width + k), np.zeros(width + k)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        score = np.bincount(row, value * weights[col], n)
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        above = np.column_stack([np.ones(n), *(sigmoid(score - t) for t in cuts), np.zeros(n)])
        slope = above * (1 - above)
        at = np.arange(n)
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        by_score = -(slope[at, grade] - slope[at, grade + 1]) / p * part
        by_cut = np.zeros(k)
        for j in range(1, k + 1):
            by_cut[j - 1] = (slope[:, j] / p * part * ((grade == j).astype(float) - (grade == j - 1))).sum()
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(col, value * by_score[row], width) + ridge * weights, [tails[0]], tails[1:] * np.exp(gaps)])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        weights, first, gaps = weights - move[:width], first - move[width], gaps - move[width + 1 :]
    return weights, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def graded(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) of every whole text, after the columns ``keep`` of ``docs``.

    severity is the expected grade, 0 to 2; p_toxic = P(grade > 0); toxic: p_toxic >= REJECT_AT; grade
    the most probable one. Null and empty texts get the grade of a text without features.
    Without a model everything is clean. Repeated rows stay, an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = Hits(model.index if model else {})
        none = Counter()
        for part in slices(batches, "text"):
            above = np.array([model.above(hits.counts(t) if t else none) if model else np.zeros(GRADES - 1) for t in part["text"]]).reshape(len(part), GRADES - 1)
            steps = np.column_stack([np.ones(len(part)), above, np.zeros(len(part))])
            yield part[keep].assign(severity=above.sum(1), p_toxic=above[:, 0], grade=(steps[:, :-1] - steps[:, 1:]).argmax(1).astype(np.int32), toxic=above[:, 0] >= REJECT_AT)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return mapped(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{schema}, severity double, p_toxic double, grade int, toxic boolean")
