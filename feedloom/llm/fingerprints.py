"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are word shingles; one that a text holds n times weighs 1 + ln n. Each term gets, by a hash of
itself, r and c from Gamma(2, 1) and b from U(0, 1) (Ioffe 2010); with weight w its sample is
t = floor(ln w / r + b), and the term with the least ln c - r (t - b + 1) is drawn, as (term, t).
Terms are first dealt over BINS by a hash, and one sample is drawn in each bin (bin-wise sampling,
Li et al. 2019), so that a term costs one sample and not one for each place of the signature. A
heavy term would rule its bin and count for little elsewhere; so weights are cut into layers of at
most 1, each a term of its own, which leaves sums of minima and maxima, and with them the
generalised Jaccard similarity, as they are. Two texts agree in a bin with the probability of that
similarity; bins that are empty in both tell nothing and are left out.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE = 5
BINS = 64
#: Documents of a block of neighbours, at least, and most blocks.
BLOCK, MOST_BLOCKS = 256, 1_000_000
#: Quantiles of the ids in between which blocks are of even width, at most; they are looked up in two steps of FAN.
SEGMENTS, FAN = 4_096, 64


def _uniform(bits: Column) -> Column:
    """U(0, 1) from 32 bits."""
    return (bits + 0.5) / float(1 << 32)


def _halves(h: Column, seed: int) -> tuple[Column, Column]:
    x = F.xxhash64(h, F.lit(seed))
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))


def _sample(term: Column) -> Column:
    """One term's sample in a long: its bin, its place among the bin's terms (34 bits), and 16 bits that tell (term, t)."""
    h, weight = term["h"], term["w"]
    (u1, u2), (u3, u4), (u5, _) = (_halves(h, seed) for seed in (1, 2, 3))
    drawn = F.array(F.struct(h.alias("h"), F.ln(weight).alias("w"), (-F.ln(_uniform(u1) * _uniform(u2))).alias("r"), F.ln(-F.ln(_uniform(u3) * _uniform(u4))).alias("c"), _uniform(u5).alias("b")))
    step = F.transform(drawn, lambda x: F.struct(x["h"].alias("h"), F.floor(x["w"] / x["r"] + x["b"]).alias("t"), x["r"].alias("r"), x["c"].alias("c"), x["b"].alias("b")))

    def packed(x: Column) -> Column:
        place = F.floor((x["c"] - x["r"] * (x["t"] - x["b"] + 1) + 200.0) * float(1 << 25))
        tag = F.xxhash64(x["h"], x["t"]).bitwiseAND(F.lit(0xFFFF))
        return F.shiftleft(F.pmod(x["h"], F.lit(BINS)), 50) + F.shiftleft(place, 16) + tag

    return F.transform(step, packed)[0]


def _unit_sample(h: Column) -> Column:
    """``_sample`` of a term of weight 1, whose t is 0, in one expression."""
    (u1, u2), (u3, u4), (u5, _) = (_halves(h, seed) for seed in (1, 2, 3))
    place = F.floor((F.ln(-F.ln(_uniform(u3) * _uniform(u4))) + F.ln(_uniform(u1) * _uniform(u2)) * (1 - _uniform(u5)) + 200.0) * float(1 << 25))
    return F.shiftleft(F.pmod(h, F.lit(BINS)), 50) + F.shiftleft(place, 16) + F.xxhash64(h, F.lit(0).cast("long")).bitwiseAND(F.lit(0xFFFF))


def with_signature(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """df with ``name``: array<long>, for each bin that has a term, bin * 65536 + the sample's tag, by bin.

    Words are split at white space and lower-cased; a text of fewer words than a shingle has one
    term, its words together; null texts and those without words have an empty signature.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn("_words", words)
    n = F.size("_words")
    shingles = F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: F.xxhash64(F.slice("_words", i, shingle)))
    df = df.withColumn("_hashes", F.when(n >= shingle, shingles).when(n > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("_once", F.array_distinct("_hashes"))
    # where terms repeat, equal ones are brought together: a run's first place, and from the next run's the term's weight
    none = F.array().cast("array<struct<h:long,i:int>>")
    df = df.withColumn("_sorted", F.when(F.size("_once") < F.size("_hashes"), F.sort_array("_hashes")))
    first = lambda x, i: (i == 0) | (x != F.get("_sorted", i - 1))
    pairs = F.zip_with("_sorted", F.sequence(F.lit(0), F.size("_sorted") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_runs", F.when(F.col("_sorted").isNotNull(), F.filter(pairs, lambda x: first(x["h"], x["i"]))).otherwise(none))
    df = df.withColumn("_runs", F.transform("_runs", lambda x, j: F.struct(x["h"].alias("h"), (F.coalesce(F.get("_runs", j + 1)["i"], F.size("_sorted")) - x["i"]).alias("n"))))
    weight = lambda x: 1 + F.ln(x["n"])
    layers = lambda x: F.transform(F.sequence(F.lit(1), F.ceil(weight(x)).cast("int") - 1), lambda j: F.struct(F.xxhash64(x["h"], j).alias("h"), F.least(F.lit(1.0), weight(x) - j).alias("w")))
    more = F.flatten(F.transform(F.filter("_runs", lambda x: x["n"] > 1), layers))
    df = df.withColumn("_drawn", F.sort_array(F.concat(F.transform("_once", _unit_sample), F.transform(more, _sample))))
    least = F.filter("_drawn", lambda x, i: (i == 0) | (F.shiftright(x, 50) != F.shiftright(F.get("_drawn", i - 1), 50)))
    df = df.withColumn(name, F.transform(least, lambda x: F.shiftleft(F.shiftright(x, 50), 16) + x.bitwiseAND(F.lit(0xFFFF))))
    return df.drop("_words", "_hashes", "_once", "_sorted", "_runs", "_drawn")


def likeness(a: Column, b: Column) -> Column:
    """The share of agreeing bins, of those that either signature fills; 1 for two empty signatures."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 16))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def written(signature: Column) -> Column:
    """Six hexadecimal digits for each filled bin: two of the bin, four of the tag."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def with_next(docs: DataFrame, prepare=lambda df: df) -> DataFrame:
    """``docs`` (doc_id, text), prepared, with next: a struct of the columns of the document that follows by
    descending doc_id; after the last comes the first.

    Ids are cut into blocks of neighbouring ids: at quantiles, which even out the gaps, and evenly in between. An id that fills
    several quantiles, such as a repeated one or none, is split by the hash of the text. Texts are shuffled once, by block. A
    block's highest document is also sent, as a ghost, to the block above, whose lowest it follows. Rows of equal id follow by
    a hash of their text; a null id is the lowest.
    """
    lowest = -(1 << 63)
    docs = docs.withColumns({"_at": F.coalesce("doc_id", F.lit(lowest)), "_h": F.xxhash64("text")})
    n = docs.count()
    segments = max(1, min(SEGMENTS, n // BLOCK))
    marks = docs.agg(F.percentile_approx("_at", [i / segments for i in range(segments + 1)], 20_000)).first()[0] or [0]
    times = Counter(marks)
    cuts = sorted(times)
    per = max(1, -(-n // (segments * max(BLOCK, -(-n // MOST_BLOCKS)))))
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    rows = [cuts[i : i + FAN] for i in range(0, len(cuts), FAN)]
    upto = lambda edges: F.size(F.filter(edges, lambda c: c <= F.col("_at")))
    # each step's outcome comes out of a one-element generator, so that it is worked out once
    docs = docs.withColumn("_row", F.greatest(upto(longs([r[0] for r in rows])) - 1, F.lit(0)))
    docs = docs.withColumn("_place", F.col("_row") * FAN + F.greatest(upto(F.get(F.array(*map(longs, rows)), "_row")) - 1, F.lit(0)))
    docs = docs.select("*", F.inline(F.array(F.struct(F.get(longs(cuts), "_place").alias("_low"), F.get(longs(cuts), F.col("_place") + 1).alias("_high"), F.get(longs([times[c] for c in cuts]), "_place").alias("_times")))))
    width = F.coalesce(F.col("_high"), F.col("_low")).cast("double") - F.col("_low").cast("double")
    within = F.floor((F.col("_at").cast("double") - F.col("_low").cast("double")) / (width + 1) * per)
    most = max(times.values())
    split = (F.col("_at") == F.col("_low")) & (F.col("_times") > 1)
    block = F.col("_place") * (most + per) + F.when(split, F.pmod("_h", "_times")).otherwise(most + F.greatest(F.least(within, F.lit(per - 1)), F.lit(0)))
    blocked = docs.withColumn("_block", block.cast("long")).drop("_row", "_place", "_low", "_high", "_times")

    ends = blocked.groupBy("_block").agg(F.max(F.struct("_at", "_h")).alias("_end"))
    along = Window.orderBy("_block")  # one row for each block, about MOST_BLOCKS at most
    above = ends.select("_block", "_end._at", "_end._h", F.coalesce(F.lead("_block").over(along), F.min("_block").over(Window.partitionBy(F.lit(0)))).alias("_above"))
    sent = blocked.join(F.broadcast(above), ["_block", "_at", "_h"], "left")  # bounded as the blocks are, some 40 MB at most
    targets = F.array_compact(F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("g")), F.when(F.col("_above").isNotNull(), F.struct(F.col("_above").alias("b"), F.lit(1).alias("g")))))
    kept = [c for c in docs.columns if c in ("doc_id", "text", "_at", "_h") or not c.startswith("_")]
    dealt = sent.withColumn("_to", F.explode(targets)).select(*kept, F.col("_to.b").alias("_block"), F.col("_to.g").alias("_ghost"))
    ready = prepare(dealt.repartition("_block"))
    own = [c for c in ready.columns if c not in ("_at", "_h", "_block", "_ghost")]
    order = Window.partitionBy("_block").orderBy(F.desc("_ghost"), "_at", "_h")
    return ready.withColumn("next", F.lag(F.struct(*own)).over(order)).where("_ghost = 0").select(*own, "next")
