"""Removal of repeated passages by suffix automata over shards of their first occurrences.

1. A window of 20 words has an anchor: the leftmost of its runs of 9 words whose hash is least. Equal
   windows have equal anchors at equal places. The neighbouring windows of one anchor make a snippet, so a
   text is a row of snippets, and each of its windows stands in one of them. Anchors are counted; those that occur
   once have windows that occur once.
2. A filter of fixed largest size tells a scan of the texts which anchors may occur again (it may
   err to that side only: a full filter costs time, never a window). Their snippets are dealt, by anchor, over shards.
3. A shard's task goes through its snippets in the order of the documents. Each is streamed through the suffix
   automaton of the windows that stood first so far; where the matching statistic reaches the
   window's length, the window has stood before. What is new joins the automaton. So the
   reference holds each window once, at its first place, and words are compared, not hashes.
4. The snippets of anchors with more than HOT places are first aggregated to the different ones, which combines
   before the shuffle; a later copy goes whole, since the first has been before it. The different ones go to the
   shards like any other. Anchors that even have more than HOT different snippets (where a passage that many texts share
   begins or ends) would make a shard too large: their windows are aggregated by two hashes to their first places.

Only snippets, places and counts are shuffled, and each text once, in the end, to meet its spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.shared import mapped, slices, written

WINDOW = 20
GRAM = 9
#: Runs of GRAM words in a window.
SPAN = WINDOW - GRAM + 1
#: Snippets of a shard, about, and the most places of an anchor whose snippets go to one.
SHARD, HOT = 4_000, 1_000
#: A filter's blocks have 2**16 bits; so many blocks at most (64 MB).
MOST_BLOCKS = 8_192
KEYS = "first long, hash long"


def hashed(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def rolled(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` values, put together from runs of half the width."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15 + 2 * seed
    times = lambda k: np.uint64(pow(base, k, 1 << 64))

    def run(k: int) -> np.ndarray:
        if k == 1:
            return h
        left, right = k - k // 2, k // 2
        a = run(left)
        b = a if right == left else run(right)
        m = len(h) - k + 1
        return a[:m] * times(right) + b[left : left + m]

    out = run(width).copy()
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def snippets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b) of each snippet of the texts whose hashed words stand in h one after another, text t from bounds[t] to bounds[t + 1]: its anchor's hash, and its windows, those that start at a to b - 1."""
    n = len(h) - WINDOW + 1
    whole = np.zeros(max(n, 0), bool)
    for a, b in zip(bounds, bounds[1:] - WINDOW + 1):
        whole[a : max(a, b)] = True
    starts = np.flatnonzero(whole)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    grams = rolled(h, GRAM, 1)
    least = _least(grams, SPAN)
    want = least[starts]
    # the leftmost place at which each window's least value stands
    some = np.concatenate([np.zeros(SPAN - 1, np.uint64), np.where(whole, least, np.uint64(0)), np.zeros(SPAN - 1, np.uint64)])
    marked = np.flatnonzero(~_least(~some, SPAN)[: len(grams)] == grams)
    at = np.searchsorted(marked, starts)
    while len(off := np.flatnonzero(grams[marked[at]] != want)):
        at[off] += 1
    place = marked[at]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return grams[place[first]], starts[first], starts[last] + 1


class Filter:
    """Bits in blocks; says of a key that was put in that it may be there."""

    def __init__(self, blocks: int, bits: np.ndarray | None = None):
        self.blocks = blocks
        self.bits = np.zeros((blocks, 1 << 13), np.uint8) if bits is None else bits

    @staticmethod
    def places(keys: np.ndarray) -> list[np.ndarray]:
        return [(keys >> np.uint64(s)) & np.uint64(0xFFFF) for s in (16, 32, 48)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        block = keys & np.uint64(self.blocks - 1)
        found = np.ones(len(keys), bool)
        for bit in self.places(keys):
            found &= (self.bits[block, bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return found


def filter_of(keys: DataFrame) -> Filter:
    """A filter that has all of ``keys`` (key: long). Each block is made in one task from its own keys; the driver joins the blocks, 64 MB at most."""
    n = keys.count()
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * (1 << 16) < 12 * n:
        blocks *= 2

    def build(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, bool)
        for bit in Filter.places(part["key"].to_numpy().astype(np.int64).view(np.uint64)):
            bits[bit] = True
        return pd.DataFrame({"block": part["block"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    made = Filter(blocks)
    for row in keys.withColumn("block", F.pmod("key", F.lit(blocks))).groupBy("block").applyInPandas(build, "block long, bits binary").toLocalIterator():
        made.bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return made


def _texts(docs: DataFrame) -> DataFrame:
    """(first, hash, nil, text) of each row. Rows stand in the order of (first, hash): doc_id, nulls first, then a hash of the text; rows that have both in common are equal."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    nil = F.col("doc_id").isNull()
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("first"), F.when(nil, F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(text)).alias("hash"), nil.alias("nil"), text.alias("text"))


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes], np.ndarray, np.ndarray, tuple]]:
    """(rows, their words, the words' hashes, bounds, snippets) by slices of the texts."""
    for part in slices(batches, "text", 4_000_000):
        texts = [t.split() for t in part["text"]]
        words = list(chain.from_iterable(texts))
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        h = hashed(words)
        yield part, words, h, bounds, snippets(h, bounds)


def anchor_counts(texts: DataFrame) -> DataFrame:
    """(key, n): the anchors that occur at more than one place, with their number of places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for *_, (keys, _, _) in _scanned(batches):
            yield pd.DataFrame({"key": keys.view(np.int64)})

    return mapped(texts.select("text"), run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def dealt_snippets(texts: DataFrame, marked: Filter, hot: Filter, shards: int) -> DataFrame:
    """(shard, first, hash, at, text): the snippets whose anchors may occur again, but for the hot ones."""
    shared = texts.sparkSession.sparkContext.broadcast(((marked.blocks, marked.bits), (hot.blocks, hot.bits)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again, often = (Filter(*f) for f in shared.value)
        for part, words, _, bounds, (keys, a, b) in _scanned(batches):
            some = again.has(keys) & ~often.has(keys)
            keys, a, b = keys[some], a[some], b[some]
            row = np.searchsorted(bounds, a, "right") - 1
            cut = [b" ".join(words[i : j + WINDOW - 1]) for i, j in zip(a.tolist(), b.tolist())]
            yield pd.DataFrame({"shard": (keys % np.uint64(shards)).astype(np.int64), "first": part["first"].to_numpy()[row], "hash": part["hash"].to_numpy()[row], "at": (a - bounds[row]).astype(np.int32), "text": cut})

    return mapped(texts.select("first", "hash", "text"), run, f"shard long, {KEYS}, at int, text binary")


def hot_snippets(texts: DataFrame, hot: Filter) -> DataFrame:
    """(key, sign, first, hash, at, n, text): the snippets of hot anchors (key), of n words; sign: a hash of the text."""
    shared = texts.sparkSession.sparkContext.broadcast((hot.blocks, hot.bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = Filter(*shared.value)
        for part, words, _, bounds, (keys, a, b) in _scanned(batches):
            some = often.has(keys)
            keys, a, b = keys[some], a[some], b[some]
            row = np.searchsorted(bounds, a, "right") - 1
            cut = [b" ".join(words[i : j + WINDOW - 1]) for i, j in zip(a.tolist(), b.tolist())]
            yield pd.DataFrame({"key": keys.view(np.int64), "sign": list(map(xxhash.xxh3_128_digest, cut)), "first": part["first"].to_numpy()[row], "hash": part["hash"].to_numpy()[row], "at": (a - bounds[row]).astype(np.int32), "n": (b - a + WINDOW - 1).astype(np.int32), "text": cut})

    return mapped(texts.select("first", "hash", "text"), run, f"key long, sign binary, {KEYS}, at int, n int, text binary")


def _windows(heads: DataFrame) -> DataFrame:
    """(w1, w2, first, hash, at): the windows of ``heads`` (first, hash, at, text), by two hashes of their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text", 4_000_000):
            hashes = [hashed(t.split(b" ")) for t in part["text"]]
            n = np.array([len(h) - WINDOW + 1 for h in hashes])
            marks = {f"w{k}": np.concatenate([rolled(h, WINDOW, k + 1) for h in hashes]).view(np.int64) for k in (1, 2)}
            at = np.repeat(part["at"].to_numpy(), n) + np.concatenate([np.arange(k) for k in n])
            yield pd.DataFrame(marks | {"first": np.repeat(part["first"].to_numpy(), n), "hash": np.repeat(part["hash"].to_numpy(), n), "at": at.astype(np.int32)})

    return mapped(heads.select("first", "hash", "at", "text"), run, f"w1 long, w2 long, {KEYS}, at int")


def _not_first(rows: DataFrame, by: list[str]) -> DataFrame:
    """Those of ``rows`` (first, hash, at, ...) that aren't the first place of what they have in common; equal rows stand at one place."""
    place = F.struct("first", "hash", "at")
    head = rows.groupBy(*by).agg(F.min(place).alias("head"), F.max(place).alias("tail")).where("head != tail").drop("tail")
    return rows.join(head, by).where(place != F.col("head"))


def hot_parts(texts: DataFrame, hot: Filter, shards: int) -> tuple[DataFrame, DataFrame]:
    """(shard, first, hash, at, text) of the different snippets of hot anchors, and (first, hash, a, b) of what goes without an automaton."""
    rows = written(hot_snippets(texts, hot))
    copies = _not_first(rows.drop("text"), ["key", "sign"]).select("first", "hash", F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b"))
    heads = written(rows.groupBy("key", "sign").agg(F.min(F.struct("first", "hash", "at")).alias("head"), F.first("text").alias("text")).select("key", "head.*", "text"))
    wide = written(heads.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    dealt = heads.join(wide, "key", "left_anti").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "first", "hash", "at", "text")
    late = _not_first(_windows(heads.join(wide, "key", "left_semi")), ["w1", "w2"]).select("first", "hash", F.col("at").alias("a"), (F.col("at") + WINDOW).alias("b"))
    return dealt, copies.unionByName(late)


class Automaton:
    """The suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, symbols: list[bytes]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            if (q := nexts[last].get(c)) is not None:  # known from another sequence
                if length[q] != length[last] + 1:
                    q = self._split(last, c, q)
                last = q
            else:
                new = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1 and c not in nexts[p]:
                    nexts[p][c] = new
                    p = link[p]
                if p != -1:
                    q = nexts[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new

    def _split(self, p: int, c: bytes, q: int) -> int:
        """A copy of q for the strings that p and c make, which have more ends than q's longest."""
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(nexts[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nexts[p].get(c) == q:
            nexts[p][c] = clone
            p = link[p]
        return clone

    def statistics(self, symbols: list[bytes]) -> Iterator[int]:
        """For each place the length of the longest match that ends there."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        for c in symbols:
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            state = nexts[state].get(c, 0)
            matched = matched + 1 if state else 0
            yield matched


def _streamed(shard: pd.DataFrame) -> pd.DataFrame:
    """(first, hash, a, b): the words of a shard's snippets that are to go, as spans of their texts."""
    automaton, rows, seen = Automaton(), [], set()
    before = None
    for first, mark, at, text in sorted(zip(shard["first"].tolist(), shard["hash"].tolist(), shard["at"].tolist(), shard["text"])):
        if before == (first, mark, at):  # an equal row
            continue
        before = (first, mark, at)
        words = text.split(b" ")
        if text in seen:  # its statistics are full by now
            rows.append((first, mark, at, at + len(words)))
            continue
        seen.add(text)
        old = [n >= WINDOW for n in automaton.statistics(words)][WINDOW - 1 :]
        i, n = 0, len(old)
        while i < n:
            j = i
            while j < n and old[j] == old[i]:
                j += 1
            if old[i]:
                rows.append((first, mark, at + i, at + j + WINDOW - 1))
            else:
                automaton.add(words[i : j + WINDOW - 1])
            i = j
    return pd.DataFrame(rows, columns=["first", "hash", "a", "b"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(first, hash, spans): by text with words to remove, the spans of words, [a, b), of its windows that also start earlier."""
    counts = written(anchor_counts(texts))
    marked, hot = filter_of(counts.select("key")), filter_of(counts.where(F.col("n") > HOT).select("key"))
    cold = counts.where(F.col("n") <= HOT).agg(F.sum("n")).first()[0] or 0
    shards = max(1, cold // SHARD)
    dealt, more = dealt_snippets(texts, marked, hot, shards), None
    if hot.bits.any():
        some, more = hot_parts(texts, hot, shards)
        dealt = dealt.unionByName(some)
    spans = dealt.groupBy("shard").applyInPandas(_streamed, f"{KEYS}, a int, b int")
    spans = spans if more is None else spans.unionByName(more)
    return spans.groupBy("first", "hash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row, its words being split at ASCII white space.

    A word goes if a window of WINDOW words covers it whose words also start earlier: in a
    document of smaller doc_id, or earlier in the same one. Windows are judged on the input.
    Null and empty texts have no words; a null doc_id is smaller than all others; each row is a document of its own, and
    rows that share a doc_id, or have none, stand in the order of a hash of their texts. Of equal rows the first is judged like
    any other, the others lose all words that a window covers. An empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text"):
            rows = []
            for text, spans, copies in zip(part["text"], part["spans"], part["copies"]):
                words = text.split()
                kept, gone = words, 0
                if spans is not None:
                    keep = np.ones(len(words), bool)
                    for s in spans:
                        keep[s["a"] : s["b"]] = False
                    kept = [words[k] for k in np.flatnonzero(keep)]
                    gone = len(words) - len(kept)
                whole = hashlib.sha256(b" ".join(words) if len(words) < WINDOW else b"").hexdigest() if copies > 1 else ""
                rows.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest(), whole))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "copy_sha256"])
            yield pd.concat([part[["first", "nil", "copies"]].reset_index(drop=True), out], axis=1)

    texts = _texts(docs)
    # equal rows meet before the shuffle, and are dealt out again in the end
    unique = texts.groupBy("first", "hash").agg(F.first("nil").alias("nil"), F.first("text").alias("text"), F.count("*").alias("copies"))
    joined = unique.join(repeated_spans(texts), ["first", "hash"], "left").select("first", "nil", "copies", "text", "spans")
    told = joined.mapInPandas(run, "first long, nil boolean, copies long, n_words long, n_removed long, kept_sha256 string, copy_sha256 string")
    dealt = told.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    later = F.col("i") > 1
    gone = F.when(later, F.when(F.col("n_words") >= WINDOW, F.col("n_words")).otherwise(0)).otherwise(F.col("n_removed"))
    return dealt.select(F.when(~F.col("nil"), F.col("first")).alias("doc_id"), "n_words", gone.cast("long").alias("n_removed"), F.when(later, F.col("copy_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
