"""Text embeddings: which records still need one, which are new, and an offline encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.records import eligible

#: What identifies an embedding.
IDENTITY = ["configuration", "object_type", "object_id", "text_checksum"]
DIMENSION = 384


def unembedded(records: DataFrame, embeddings: DataFrame, configuration: str, most: int | None = None) -> DataFrame:
    """Eligible records that have no embedding of the configuration yet, oldest first. A text that has changed since isn't asked for again."""
    done = embeddings.where((F.col("configuration") == configuration) & (F.col("object_type") == "feedback_record")).select(F.col("object_id").alias("record_id"))
    left = eligible(records).join(done, "record_id", "left_anti")
    return left if most is None else left.orderBy("record_id").limit(most)


def new_embeddings(stock: DataFrame, arriving: DataFrame) -> DataFrame:
    """The arriving embeddings that the stock hasn't: one for each (configuration, object, text), the rest stay as they are."""
    return arriving.dropDuplicates(IDENTITY).join(stock.select(*IDENTITY), IDENTITY, "left_anti")


def encoded(text: Column, dimension: int = DIMENSION) -> Column:
    """A unit vector of a text: its words and pairs of words are hashed to a place and a sign and added up (feature hashing). Null and wordless texts have none.

    It stands in for a trained encoder where none can be had.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def vector(w: Column) -> Column:
        pairs = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda b, i: F.concat_ws(" ", F.get(w, i), b))
        marks = F.transform(F.concat(w, pairs), lambda t: F.xxhash64(t))
        sums = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda d: F.aggregate(F.filter(marks, lambda h: F.pmod(h, F.lit(dimension)) == d), F.lit(0.0), lambda s, h: s + F.when(F.shiftright(h, 62).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0)))
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(F.array(F.struct(sums.alias("v"))), lambda x: F.transform(F.array(norm(x["v"])), lambda n: F.when(n > 0, F.transform(x["v"], lambda e: (e / n).cast("float"))))[0])[0]

    return F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, vector(w)))[0]
