"""How far the sources of each language differ in their terms.

A baseline-correction inverted index: each pair of sources starts at V times the f of two zero counts, as if no kept
term stood in either. A term that one of them has corrects this; such corrections depend on its count alone, so they go by a
source's histogram of counts. A term that both have corrects the sum of these two once more, from the postings of that
term. Sums of whole numbers make the result exact. The terms in which a source exceeds its language are ranked by a window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.shared import ROWS, batches_of, slices, written
from feedloom.llm.terms import alphabet, pieces

#: Documents of a language that a kept term stands in, at least; ranks of terms that are told.
FEWEST, RANKS = 10, 10
#: Different terms of sources that a task counts before it hands them on.
HELD = 1 << 19
LETTERS = alphabet(digits=False)


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of a term, as far as a task has counted before handing them on."""

    def strings(found: list[bytes]) -> pa.Array:
        try:
            return pa.array(found, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            return pa.array([t.decode("utf-8", "replace") for t in found], pa.string())

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in ((k, v) for k, v in held.items() if v[0]):
            group = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
            counts = [pa.array(list(x), pa.int64()) for x in (n.values(), map(d.__getitem__, n))]
            yield pa.RecordBatch.from_arrays([*group, strings(list(n)), *counts], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for part in slices((b.to_pandas() for b in batches), "text"):
            for lang, source, text in zip(part["lang"], part["source"], part["text"]):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for words in pieces(text, LETTERS):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                size += len(n)
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("lang", "source", text.alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str, kept: str) -> Column:
    """p of a count: exact, as decimals don't overflow where long products would."""
    return F.expr(f"1 + cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * {kept} as decimal(20,0))")


def gap(p: str, q: str) -> Column:
    """f of two shares, each of at most 10^9 + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audited(documents: DataFrame, fewest: int = FEWEST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``documents`` (text, lang, source).

    part ``pair``: the divergence of a source from each other source of its language, over the terms that stand in ``fewest``
    documents of the language or more; part ``term``: the terms in which it most exceeds its language. Rows without a text,
    a language or a source have '' for it; repeated rows are documents of their own; an empty table gives no rows. A group
    without terms has its pairs, a language without kept terms has pairs of value 0. Equal values go by the item's bytes.
    Other columns are ignored. The pairs are as many as the contract's result: each two sources of a language.
    """
    docs = documents.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    with batches_of(docs.sparkSession, ROWS):
        counted = written(partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= fewest)
    postings = written(counted.join(terms.select("lang", "term", "whole"), ["lang", "term"]).select("lang", "term", "source", "n", "whole"))

    by_lang = postings.groupBy("lang", "term").agg(F.max("whole").alias("whole")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    # zero: the share of a term that the group doesn't have; without kept terms nothing asks for it
    groups = written(groups.withColumn("zero", F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(F.lit(1).cast("long"))))
    shares = postings.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))

    return _pairs(groups, written(shares)).unionByName(_terms(shares, ranks))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    one = groups.select("lang", F.col("source").alias("a"), "v", F.col("zero").alias("za"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))
    bases = one.join(two, "lang").where("a < b").select("lang", "a", "b", (F.col("v") * gap("za", "zb")).alias("value"))

    # what the counts of one source alone correct
    histogram = shares.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("n")).select("lang", F.col("source").alias("a"), "p", F.col("zero").alias("za"), "n")
    single = histogram.join(two, "lang").where("a <> b").withColumn("value", F.col("n") * (gap("p", "zb") - gap("za", "zb"))).where("value <> 0")
    single = single.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")

    # what the terms that both have correct beyond that
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    both = left.join(right, ["lang", "term"]).where("a < b")
    both = both.select("lang", "a", "b", (gap("pa", "pb") - gap("pa", "zb") - gap("za", "pb") + gap("za", "zb")).alias("value")).where("value <> 0")

    summed = bases.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(summed.select("lang", "value", sides), "pair")


def _terms(shares: DataFrame, ranks: int) -> DataFrame:
    above = shares.withColumn("q", share("whole", "lang_total", "v")).where("p > q")
    return _ranked(above.select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value")), "term").where(F.col("rank") <= ranks)


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
