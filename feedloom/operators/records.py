"""From raw items to canonical feedback records: text rules, exact and near-duplicates, processing summary."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import privacy, text
from feedloom.operators.likeness import compared
from feedloom.storage import tabled

LEAST_NEAR, NEAR = 20, 0.85
#: Buckets that words are counted in, and sets that a task takes at once.
BUCKETS, ROWS = 1 << 20, 2_048
#: Parts that are cut beyond those needed, as a share of these: the commonest so many are left out.
SPARE = 0.25
#: Bits that tell how much two sets differ at least, those of sets of so many words or more, and the longs of the first.
BITS, WIDER, WIDE = 256, 1_024, 640
LONGS = BITS // 64
#: What rounding can do to a bound on sizes.
CLOSE = 1e-6


def canonical(raw: DataFrame, code: Column | None = None) -> DataFrame:
    """raw (record_id, connector, text, ...) with the record's derived columns, in the fixed order of the rules.

    The normalised text comes out of a generator over one element, which the optimizer doesn't
    see through: every rule and filter reads the one value instead of working it out again.
    """
    once = F.array(F.struct(text.normalized(F.col("text")).alias("normalized")))
    df = raw.select("*", F.inline(once))
    df = df.withColumn("language", text.language(F.col("normalized"), text.guessed_language(F.col("normalized")) if code is None else code))
    df = df.withColumn("_done", privacy.redacted(F.col("normalized"))).withColumn("redacted", F.col("_done.redacted")).withColumn("events", F.col("_done.events")).drop("_done")
    df = df.withColumn("content_hash", text.content_hash(F.col("normalized")))
    return df.withColumn("relevance", text.relevance(F.col("normalized"))).withColumn("quality", text.quality(F.col("text"), F.col("normalized"), F.col("language")))


def eligible(df: DataFrame) -> DataFrame:
    """The records that analysis may use."""
    return df.where(F.col("quality").isin("usable", "low_information") & ~F.col("relevance").isin("insufficient_content", "spam_or_promotion") & F.col("deleted_at").isNull())


def unclassified(records: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Eligible records without a classification (record_id), oldest first where ``most`` are asked for."""
    left = eligible(records).join(done.select("record_id"), "record_id", "left_anti")
    return left if most is None else left.orderBy("record_id").limit(most)


def pending_media(records: DataFrame, connector: str | None = None, most: int | None = None) -> DataFrame:
    """Records with media that nothing was extracted from yet, oldest first. An empty extracted text says that it failed, and isn't tried again."""
    df = records.where("media_url is not null and extracted_media_text is null and deleted_at is null")
    df = df if connector is None else df.where(F.col("connector") == connector)
    return df if most is None else df.orderBy("record_id").limit(most)


def exact_duplicates(records: DataFrame) -> DataFrame:
    """(record_id, canonical_id, duplicate_type): each record whose hash an earlier, not deleted record has, of whatever connector.

    The earliest of a hash is one minimum aggregate, which combines before the shuffle, and comes
    back by an equi-join that adaptive execution can split.
    """
    first = records.where("deleted_at is null").groupBy("content_hash").agg(F.min(F.struct("record_id", "connector")).alias("first"))
    found = records.join(first, "content_hash").where(F.col("first.record_id") < F.col("record_id"))
    kind = F.when(F.col("connector") == F.col("first.connector"), "exact").otherwise("cross_source_repost")
    return found.select("record_id", F.col("first.record_id").alias("canonical_id"), kind.alias("duplicate_type"))


def token_classes(records: DataFrame) -> DataFrame:
    """(scope, class_id, words, members): each different token set of a scope once, under its least record_id."""
    sets = records.select("scope", "record_id", F.sort_array("words").alias("words"))
    return sets.groupBy("scope", "words").agg(F.min("record_id").alias("class_id"), F.count("*").alias("members"))


def _levels(largest: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The sizes up to which the levels go, and by how many words two sets of a level can differ. A set as like as ``least`` to one of a level is of this level or the next one."""
    tops = [0, 1]
    while tops[-1] < largest or len(tops) < 3:
        tops.append(max(tops[-1] + 1, math.floor(tops[-1] / least + CLOSE)))
    top = np.array([*tops, max(tops[-1] + 1, math.floor(tops[-1] / least + CLOSE))])
    return top[:-1], np.floor((1 - least) / (1 + least) * (top[:-1] + np.minimum(top[1:], top[:-1] / least)) + CLOSE).astype(np.int64)


def _parts(classes: DataFrame, least: float) -> DataFrame:
    """(scope, class_id, top, key, before..): hashes of parts of each set, of which two sets as like as ``least`` share one; and of the set's two parts before it, or 0.

    Sets of neighbouring sizes, a level, are cut by the words' hashes into the same parts, more than the words by which two of them can differ; so some parts are equal. There are
    SPARE more than that needs, and each set leaves out as many, those of the commonest words: of all parts that two sets share
    they order each alike, so the rarest is left out by neither. A part is several words, so chance makes few equal. A set is in its own level (``top``)
    and the one below. Words are counted in buckets, and a part that has a word of no other set is left out, too.
    """
    words = F.transform("words", lambda w: F.xxhash64(w))
    known = classes.select(F.explode(words).alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int32)
    counts[known["bucket"].to_numpy()] = known["n"].to_numpy()
    largest = classes.agg(F.max(F.size("words"))).first()[0] or 0
    shared = classes.sparkSession.sparkContext.broadcast((counts, *_levels(largest, least)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, tops, differ = shared.value
        mixed = lambda x: (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                sizes = part["h"].str.len().to_numpy(np.int64)
                h, row = np.concatenate(part["h"].to_list()).view(np.uint64), np.repeat(np.arange(len(part)), sizes)
                count = often[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
                rare = np.rint(1_000 * np.log(2**32 / count)).astype(np.int64)
                for lower in (0, 1):
                    level = np.searchsorted(tops, sizes) - lower
                    need = np.where(level > 0, differ[level] + 1, 0)
                    many = need + np.floor(need * SPARE).astype(np.int64)
                    start = np.cumsum(many) - many
                    own = many[row] > 0
                    r, x = row[own], h[own]
                    place = start[r] + (mixed(x) >> np.uint64(32)).astype(np.int64) % many[r]
                    order, total = np.argsort(place, kind="stable"), int(many.sum())
                    ends = np.searchsorted(place[order], np.arange(total + 1))
                    summed = np.concatenate([[np.uint64(0)], np.cumsum(mixed(x ^ x >> np.uint64(32))[order], dtype=np.uint64)])
                    of, number = np.repeat(np.arange(len(part)), many), np.arange(total) - np.repeat(start, many)
                    worth = np.bincount(place, rare[own], total).astype(np.int64)
                    alone = np.bincount(place, count[own] == 1, total) > 0
                    order = np.lexsort((number, -worth, of))
                    kept = order[(np.arange(total) - start[of[order]] < need[of[order]]) & ~alone[order]]
                    key = mixed(summed[ends[1:]] - summed[ends[:-1]]) ^ mixed((level[of] << 32 | number).astype(np.uint64))
                    yield pd.DataFrame({"scope": part["scope"].to_numpy()[of[kept]], "class_id": part["class_id"].to_numpy()[of[kept]], "top": np.full(len(kept), lower == 0), "key": key[kept].view(np.int64)} | {f"before{n}": np.concatenate([np.zeros(min(n, len(kept)), np.int64), np.where(of[kept[n:]] == of[kept[:-n]], key[kept[:-n]].view(np.int64), 0)]) for n in (1, 2)})

    sets = classes.where(F.size("words") > 0).select("scope", "class_id", words.alias("h"))
    return sets.mapInPandas(cut, f"scope {classes.schema['scope'].dataType.simpleString()}, class_id long, top boolean, key long, before1 long, before2 long")


def _bits(classes: DataFrame) -> DataFrame:
    """(scope, class_id, n, bits..): of each part of the words' hashes whether the set has an odd number, in longs; a set of WIDE words or more has WIDER bits, which fold to those of a smaller one, whose other longs are zero."""

    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                sizes = part["h"].str.len().to_numpy(np.int64)
                h, row = np.concatenate(part["h"].to_list()), np.repeat(np.arange(len(part)), sizes)
                single = (np.bincount(row * WIDER + (h >> 32 & WIDER - 1), minlength=len(part) * WIDER) & 1).astype(np.uint8)
                bits = np.packbits(single.reshape(-1, WIDER), axis=1).view(np.int64)
                few = sizes < WIDE
                bits[few, :LONGS] = np.bitwise_xor.reduce(bits[few].reshape(-1, WIDER // BITS, LONGS), axis=1)
                bits[few, LONGS:] = 0
                yield pd.DataFrame({"scope": part["scope"].to_numpy(), "class_id": part["class_id"].to_numpy(), "n": sizes} | {f"bits{i}": bits[:, i] for i in range(WIDER // 64)})

    longs = ", ".join(f"bits{i} long" for i in range(WIDER // 64))
    sets = classes.where(F.size("words") > 0).select("scope", "class_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    return sets.mapInPandas(odd, f"scope {classes.schema['scope'].dataType.simpleString()}, class_id long, n int, {longs}")


def similar_classes(classes: DataFrame, least: float = NEAR) -> DataFrame:
    """(scope, a, b, similarity), a < b: pairs of different token sets of one scope whose Jaccard likeness reaches ``least``.

    Sets are cut into parts of which two as like as that share one. What shares a part is tested by sizes and, by their
    bits, by how much two sets differ at least; only what passes meets the whole sets. ``classes`` is
    read several times, so give a stored table.
    """
    keyed = _parts(classes, least)
    a, b = keyed.alias("a"), keyed.alias("b")
    # two sets that share the part before, too, meet there
    again = reduce(Column.__or__, ((F.col(f"a.before{n}") == F.col(f"b.before{n}")) & (F.col(f"a.before{n}") != 0) for n in (1, 2)))
    shared = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.class_id") < F.col("b.class_id")) & (F.col("a.top") | F.col("b.top")) & ~again)
    shared = shared.select("a.scope", F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b")).distinct()
    bits = _bits(classes)
    of = lambda c: bits.select("scope", F.col("class_id").alias(c), F.struct(*[x for x in bits.columns if x not in ("scope", "class_id")]).alias(f"of_{c}"))
    both = shared.join(of("a"), ["scope", "a"]).join(of("b"), ["scope", "b"])
    size, other = F.col("of_a.n"), F.col("of_b.n")
    unlike = [F.col(f"of_a.bits{i}").bitwiseXOR(F.col(f"of_b.bits{i}")) for i in range(WIDER // 64)]
    differ = reduce(add, map(F.bit_count, unlike)), reduce(add, (F.bit_count(reduce(Column.bitwiseXOR, unlike[i::LONGS])) for i in range(LONGS)))
    differ = F.when(F.least(size, other) >= WIDE, differ[0]).otherwise(differ[1])
    need = F.ceil(least / (1 + least) * (size + other) - CLOSE)
    fits = (F.least(size, other) >= F.greatest(size, other) * least - CLOSE) & (differ <= size + other - 2 * need)
    pairs = tabled(both.where(fits).select("scope", "a", "b"))
    return compared(pairs, classes, least)


def near_duplicates(records: DataFrame, least: float = NEAR, scope: str = "connector", without: DataFrame | None = None) -> DataFrame:
    """(record_id, canonical_id, similarity): each record that is, in order of record_id, like an earlier primary one of its scope.

    A record is primary if no earlier primary is like it; else it belongs to the one most like
    it, the newest of equals. Every earlier primary is compared, however many there are.
    Records decide in rounds: those whose earlier neighbours have all decided. Records of one
    token set decide as one, since its first member always decides for the rest. Records in ``without``
    (record_id) are left out; texts don't move for that, nor do the sets that stand for no other.
    """
    fit = records.where(F.length("normalized") >= LEAST_NEAR).select(F.col(scope).alias("scope"), "record_id", F.sort_array(text.tokens(F.col("normalized"))).alias("words"))
    # words hold no blank, so the hash is that of the set
    fit = tabled(fit.withColumn("same", F.sha2(F.array_join("words", " "), 256)))
    kept = fit.select("scope", "record_id", "same")
    kept = kept if without is None else tabled(kept.join(without.select("record_id"), "record_id", "left_anti"))
    heads = tabled(kept.groupBy("scope", "same").agg(F.min("record_id").alias("class_id")))
    first = heads.select("scope", "same", F.col("class_id").alias("record_id"))
    classes = tabled(fit.join(first, ["scope", "same", "record_id"], "left_semi").select("scope", F.col("record_id").alias("class_id"), "words"))
    links = tabled(similar_classes(classes, least))
    # b is the later of the two; its state follows from the a's
    state = tabled(links.select("scope", F.col("a").alias("id")).union(links.select("scope", F.col("b").alias("id"))).distinct().withColumn("primary", F.lit(None).cast("boolean")))
    while state.where("primary is null").limit(1).count():
        earlier = links.join(state.select("scope", F.col("id").alias("a"), "primary"), ["scope", "a"]).groupBy("scope", F.col("b").alias("id")).agg(F.bool_or(F.coalesce("primary", F.lit(False))).alias("hit"), F.count_if(F.col("primary").isNull()).alias("open"))
        new = F.when(F.col("primary").isNotNull(), F.col("primary")).when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = tabled(state.join(earlier, ["scope", "id"], "left").select("scope", "id", new.alias("primary")))
    loners = heads.select("scope", F.col("class_id").alias("id")).join(state, ["scope", "id"], "left").select("scope", "id", F.coalesce("primary", F.lit(True)).alias("primary"))
    primary = loners.where("primary").select("scope", F.col("id").alias("canonical_id"))
    both = links.select("scope", F.col("a").alias("of"), F.col("b").alias("canonical_id"), "similarity").union(links.select("scope", F.col("b").alias("of"), F.col("a").alias("canonical_id"), "similarity"))
    both = both.union(heads.select("scope", F.col("class_id").alias("of"), F.col("class_id").alias("canonical_id"), F.lit(1.0).alias("similarity")))
    targets = both.join(primary, ["scope", "canonical_id"])
    members = kept.join(heads.withColumnRenamed("class_id", "of"), ["scope", "same"]).select("scope", "of", "record_id")
    found = members.join(targets, ["scope", "of"]).where(F.col("canonical_id") < F.col("record_id"))
    best = found.groupBy("record_id").agg(F.max(F.struct("similarity", "canonical_id")).alias("best"))
    return best.select("record_id", F.col("best.canonical_id").alias("canonical_id"), F.col("best.similarity").alias("similarity"))


def duplicate_links(records: DataFrame, least: float = NEAR) -> DataFrame:
    """A link for each duplicate: exact ones first, near ones among the records that are none."""
    exact = tabled(exact_duplicates(records))
    near = near_duplicates(records.where("deleted_at is null"), least, without=exact).withColumn("duplicate_type", F.lit("near"))
    links = exact.withColumn("similarity", F.lit(1.0)).unionByName(near)
    return links.select("record_id", "canonical_id", "duplicate_type", "similarity", F.lit("rule").alias("method"), F.lit(1).alias("version"))


def with_primary(records: DataFrame, links: DataFrame) -> DataFrame:
    joined = records.join(links.select("record_id", F.col("canonical_id").alias("duplicate_of")), "record_id", "left")
    return joined.withColumn("is_primary_for_counts", F.col("duplicate_of").isNull())


def summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("processed"), F.count_if(~F.col("is_primary_for_counts")).alias("duplicates"), F.count_if(F.col("quality") == "malformed").alias("malformed"))


def prefix_length(n: int, least: float = NEAR) -> int:
    return n - math.ceil(n * least) + 1
