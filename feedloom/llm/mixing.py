"""Mixing sources to target weights by Pfair scheduling of their blocks, in DataFrame operations only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush
from itertools import islice
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.shared import checkpointed, shared_folder

#: Slots of a round for the default weights, or so many for each source, whichever is more; and for given weights, which count to so many parts of their sum.
ROUND, ROUND_EACH, PARTS = 1_000, 16, 1_000_000
#: Ended sources keep their slots until these are so many times the blocks.
EMPTY = 4
#: Slots of the round that are stored at a time.
PLACES = 50_000
#: Documents of a block.
BLOCK = 16
#: A source is numbered in buckets of so many rows, or in MOST_BUCKETS larger ones.
BUCKET, MOST_BUCKETS = 500, 65_536
#: Default weights are each source's share of documents to this power.
TEMPER = 0.5


def quotas(weights: Mapping[str, float], slots: int = ROUND) -> dict[str, int]:
    """Slots of a round for each source, in proportion to its weight by largest remainders, one at least."""
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources don't fit {slots} slots; take longer rounds")
    total = sum(weights.values())
    exact = {s: slots * w / total for s, w in weights.items()}
    given = {s: max(1, int(x)) for s, x in exact.items()}
    off = slots - sum(given.values()) if given else 0
    step = 1 if off > 0 else -1
    # those furthest from their exact share give or take a slot first
    able = [((given[s] - exact[s]) * step, s) for s in given if step > 0 or given[s] > 1]
    heapify(able)
    for _ in range(abs(off)):
        _, s = heappop(able)
        given[s] += step
        if step > 0 or given[s] > 1:
            heappush(able, ((given[s] - exact[s]) * step, s))
    return given


def timed(weights: Mapping[str, float], sizes: Mapping[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of the first ``sizes`` blocks of each source, by earliest deadline first; in whole numbers, so exactly.

    Block k (from 0) of a source with weight w is released at floor(k / w) and due at
    ceil((k + 1) / w). Weights sum to 1, so every deadline is met: up to any slot, no source
    deviates from its target by a whole block. A source that has ended leaves its slots empty, until
    the slots are several times the blocks; from there on the blocks left take the first empty slot after their release.
    """
    ratios = {s: w.as_integer_ratio() for s, w in weights.items()}
    scale = max((d for _, d in ratios.values()), default=1)
    scale = scale if all(scale % d == 0 for _, d in ratios.values()) else lcm(*(d for _, d in ratios.values()))
    share = {s: n * (scale // d) for s, (n, d) in ratios.items()}
    whole = sum(share.values())
    left = sum(sizes.values())
    empty = EMPTY * left + ROUND
    coming = [(0, s, 0) for s in share]
    heapify(coming)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while left:
        while coming and coming[0][0] <= slot:
            _, s, k = heappop(coming)
            if k < sizes[s] or slot < empty:
                heappush(ready, (-((k + 1) * whole // -share[s]), s, k))
        if not ready:
            slot = coming[0][0]
            continue
        _, s, k = heappop(ready)
        if k < sizes[s]:
            yield s, k, slot
            left -= 1
        heappush(coming, ((k + 1) * whole // share[s], s, k + 1))
        slot += 1


def schedule(quota: Mapping[str, int]) -> list[str]:
    """The source of each slot of a round, in which every source has its quota of slots."""
    return [s for s, _, _ in timed(quota, quota)]


def whole_weights(weights: Mapping[str, float], slots: int) -> dict[str, int]:
    """The weights as whole numbers of slots of a round, in lowest terms: in proportion to ``slots`` parts of their sum, one at least."""
    quota = quotas(weights, max(slots, len(weights)))
    common = gcd(*quota.values()) if quota else 1
    return {s: n // common for s, n in quota.items()}


def round_of(sizes: DataFrame, weights: Mapping[str, float] | None) -> tuple[int, DataFrame]:
    """(slots of a round, (_key, _quota, _turn, _slot)): the schedule of a round for the sources in ``sizes`` (_key, n), in which source _key takes its turn _turn at _slot.

    Weights are whole numbers of slots, so after a round every source has had exactly its share, and the schedule
    starts again: one round is all that is worked out, however many blocks there are. The driver makes it, with a row for each
    source and a step for each slot of the round, and stores it in the shared folder.
    """
    spark = sizes.sparkSession
    n = {r["_key"]: r["n"] for r in sizes.collect()}
    quota = whole_weights({s: x**TEMPER for s, x in n.items()}, max(ROUND, ROUND_EACH * len(n))) if weights is None else whole_weights({s: weights[s] for s in n}, PARTS)
    turns = timed(quota, quota)
    folder = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    some = list(islice(turns, PLACES))
    while True:
        _table(sizes, [{"_key": s, "_quota": quota[s], "_turn": k, "_slot": slot} for s, k, slot in some], "_key string, _quota long, _turn long, _slot long").write.mode("append").parquet(folder)
        if not (some := list(islice(turns, PLACES))):
            return sum(quota.values()), spark.read.parquet(folder)


def _table(docs: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, made in the plan itself."""
    return docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, source, ...) with slot and position, by which they are in the mixed order.

    Each source's documents, shuffled by a hash of doc_id, make blocks; the blocks take their
    source's slots in turn. Every prefix of whole slots holds, of each source that has not ended in it,
    its weight's share within less than a block, however long the table is; the slots of sources that have
    ended stay empty, so positions have gaps but no row is left out. ``weights``: by source,
    all sources that are in ``docs``, counted to a millionth of their sum; by default the square root of each source's size, as whole
    numbers of the slots of a round (``whole_weights``). A null source counts as "", repeated rows take a place each, an empty table
    gives no rows. Columns of ``docs`` that are called slot or position give way to the new ones.
    """
    docs = docs.drop("slot", "position")
    keyed = docs.withColumn("_key", F.coalesce("source", F.lit("")))
    sizes = checkpointed(keyed.groupBy("_key").agg(F.count("*").alias("n")))
    if weights is not None:
        able = _table(docs, [{"_key": s} for s, w in weights.items() if w > 0], "_key string")
        if missing := [r["_key"] for r in sizes.join(able, "_key", "left_anti").limit(5).collect()]:
            raise ValueError(f"no weight for {missing}")
    slots, turns = round_of(sizes, weights)
    shares = turns.where("_turn = 0").select("_key", "_quota")
    buckets = sizes.join(shares, "_key").select("_quota", "_key", F.ceil(F.col("n") / F.greatest(F.lit(BUCKET), F.floor(F.col("n") / MOST_BUCKETS))).alias("_buckets"))

    # numbering: each bucket counts by itself, and the buckets before it are summed, so that no task has a whole source
    mark = F.xxhash64("doc_id", F.lit(77))
    dealt = keyed.join(F.broadcast(buckets), "_key")  # a row for each source, which the driver has had
    dealt = dealt.withColumn("_bucket", F.pmod(mark, "_buckets"))
    counts = checkpointed(dealt.groupBy("_key", "_bucket").agg(F.count("*").alias("_rows")))
    whole = Window.partitionBy("_key").orderBy("_bucket")
    before = counts.select("_key", "_bucket", (F.sum("_rows").over(whole) - F.col("_rows")).alias("_before"))
    ties = [c for c, kind in docs.dtypes if c != "doc_id" and not kind.startswith(("map", "variant"))]
    own = Window.partitionBy("_key", "_bucket").orderBy(mark, "doc_id", F.xxhash64(*ties))
    placed = dealt.withColumn("_place", F.row_number().over(own)).join(before, ["_key", "_bucket"])
    number = F.col("_before") + F.col("_place") - 1
    blocked = placed.withColumn("_block", F.floor(number / block)).withColumn("_in", number % block)
    blocked = blocked.withColumn("_turn", F.col("_block") % F.col("_quota")).withColumn("_round", F.floor(F.col("_block") / F.col("_quota")))
    slot = F.col("_round") * slots + F.col("_slot")
    # a round has PARTS slots or ROUND_EACH for each source: 40 MB for a million
    placed = blocked.join(F.broadcast(turns.drop("_quota")), ["_key", "_turn"]).withColumn("_slot", slot)
    return placed.select(*(docs[c] for c in docs.columns), F.col("_slot").alias("slot"), (F.col("_slot") * block + F.col("_in")).alias("position"))
