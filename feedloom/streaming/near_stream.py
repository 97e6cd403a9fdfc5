"""Near-duplicates of a stream: each scope's newest primaries are kept as state, records meet them as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.functions import text
from feedloom.operators.records import LEAST_NEAR, NEAR, prefix_length

#: Primaries that a scope keeps; older ones go first.
RECENT = 500
#: Where the state lives: list states and timers need this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "scope string, record_id long, canonical_id long, similarity double"
KEPT = "record_id long, at timestamp, words array<string>"


class Primaries:
    """The primaries of one scope in order of arrival, found by the rarest words of an arriving set.

    A set whose likeness to one of ``n`` words reaches ``least`` shares at least least * n of them, so it holds
    one of any n - ceil(least * n) + 1: those that the fewest primaries hold are looked up. Each primary has a
    place, and a word the places that hold it, as the bits of a number.
    """

    def __init__(self, least: float):
        self.least, self.held, self.by_word = least, {}, {}
        self.places, self.free = [], []

    def add(self, record_id: int, at, words: tuple) -> None:
        if not self.free:
            self.free.append(len(self.places))
            self.places.append(None)
        place = self.free.pop()
        self.places[place] = record_id
        self.held[record_id] = (at, words, frozenset(words), place)
        bit, by_word = 1 << place, self.by_word
        # sets without words are alike; no word is empty
        for w in words or ("",):
            by_word[w] = by_word.get(w, 0) | bit

    def drop(self, record_id: int) -> None:
        _, words, _, place = self.held.pop(record_id)
        self.free.append(place)
        bit, by_word = 1 << place, self.by_word
        for w in words or ("",):
            if left := by_word[w] ^ bit:
                by_word[w] = left
            else:
                del by_word[w]

    def _sharing(self, words: tuple) -> int:
        """The places of the primaries that hold one of the rarest words."""
        known = [bits for w in words or ("",) if (bits := self.by_word.get(w))]
        # the words that no primary holds are the rarest
        looked_up = max(prefix_length(len(words), self.least), 1) - (len(words or ("",)) - len(known))
        if looked_up <= 0:
            return 0
        found = 0
        for bits in sorted(known, key=int.bit_count)[:looked_up]:
            found |= bits
        return found

    def best(self, words: tuple) -> tuple[float, int] | None:
        """(similarity, record_id) of the likest primary, the newest of equals; None where none reaches ``least``."""
        mine, found, sharing = frozenset(words), None, self._sharing(words)
        while sharing:
            other = self.places[(sharing & -sharing).bit_length() - 1]
            sharing &= sharing - 1
            theirs = self.held[other][2]
            if min(len(mine), len(theirs)) < self.least * max(len(mine), len(theirs)):
                continue
            shared = len(mine & theirs)
            likeness = shared / (len(mine) + len(theirs) - shared) if mine or theirs else 1.0
            if likeness >= self.least and (found is None or (likeness, other) > found):
                found = likeness, other
        return found


class _Near(StatefulProcessor):
    def __init__(self, least: float, recent: int, keep: timedelta):
        self.least, self.recent, self.keep = least, recent, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("primaries", KEPT)

    def _load(self, watermark_ms: int) -> Primaries:
        """The state without what has expired by the watermark."""
        out, oldest = Primaries(self.least), pd.Timestamp(max(watermark_ms, 0), unit="ms") - self.keep
        for record_id, at, words in self.state.get():
            if pd.Timestamp(at).tz_localize(None) >= oldest:
                out.add(record_id, at, tuple(words))
        return out

    def _save(self, primaries: Primaries) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if not primaries.held:
            self.state.clear()
            return
        self.state.put([(i, at, list(words)) for i, (at, words, *_) in primaries.held.items()])
        # the first moment at which one of them has expired
        oldest = min(pd.Timestamp(at).tz_localize(None) for at, *_ in primaries.held.values())
        self.handle.registerTimer(int((oldest + self.keep).timestamp() * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        primaries = self._load(timerValues.getCurrentWatermarkInMs())
        found = []
        for r in pd.concat(list(rows)).sort_values("record_id", kind="stable").itertuples():
            if r.record_id in primaries.held:  # the same record again
                continue
            words = tuple(r.words.split())
            if best := primaries.best(words):
                found.append((key[0], r.record_id, best[1], best[0]))
                continue
            primaries.add(r.record_id, r.at, words)
            if len(primaries.held) > self.recent:
                primaries.drop(next(iter(primaries.held)))
        self._save(primaries)
        yield pd.DataFrame(found, columns=["scope", "record_id", "canonical_id", "similarity"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._save(self._load(timerValues.getCurrentWatermarkInMs()))
        yield pd.DataFrame({"scope": pd.Series(dtype=str), "record_id": pd.Series(dtype="int64"), "canonical_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def near_duplicate_stream(records: DataFrame, at: str, least: float = NEAR, scope: str = "connector", recent: int = RECENT, delay: str = "1 day", keep: timedelta = timedelta(days=365)) -> DataFrame:
    """(scope, record_id, canonical_id, similarity) of the arriving records (record_id, normalized, the columns ``scope`` and ``at``) that are like a primary one of their scope that came before.

    A record is primary if none that is held is like it; else it belongs to the likest, the newest of
    equals. Within a micro-batch records come in order of record_id, across batches as they arrive:
    where ids rise from batch to batch and no primary has left the state, the result is that of
    ``records.near_duplicates`` on the whole.

    A scope holds its ``recent`` last primaries and none whose time is ``keep`` before the watermark, so the state
    is bounded by the number of scopes. Rows later than ``delay`` go by the watermark. Left out are texts
    under the least length and rows without id or time; a null scope is a scope of its own. A record that comes again
    while it is primary isn't its own copy. One scope's rows of one micro-batch meet in one task, so bound
    a trigger's input (``maxFilesPerTrigger``). The session needs ``PROVIDER`` as its state store.
    """
    spark = records.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    # a generator keeps the optimizer from working the text out again for the filter
    told = records.select(F.col(scope).alias("scope"), "record_id", at, F.inline(F.array(F.struct("normalized"))))
    fit = told.where((F.length("normalized") >= LEAST_NEAR) & F.col("record_id").isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    fit = fit.select("scope", F.col("record_id").cast("long").alias("record_id"), F.col(at).alias("at"), F.array_join(text.tokens(F.col("normalized")), " ").alias("words"))
    return fit.groupBy("scope").transformWithStateInPandas(_Near(least, recent, keep), OUT, "Append", "EventTime")
