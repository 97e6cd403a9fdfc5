"""The mix of sources against the true weights, over many rounds."""

from fractions import Fraction

import pytest

from feedloom.llm import mixing


def drift(placed, weights, sizes):
    """The largest deviation of a source that hasn't ended, in blocks, over all prefixes of slots; placed: (source, block, slot)."""
    total = sum(map(Fraction, weights.values()))
    worst, seen = Fraction(0), dict.fromkeys(weights, 0)
    at = {slot: s for s, _, slot in placed}
    assert len(at) == len(placed)
    for slot in range(max(at) + 1):
        if slot in at:
            seen[at[slot]] += 1
        for s, w in weights.items():
            if seen[s] < sizes[s]:
                worst = max(worst, abs(seen[s] - Fraction(w) / total * (slot + 1)))
    return worst


def test_no_prefix_of_many_rounds_is_a_block_off():
    rows = {"hot": 10_000_000} | {f"s{n:02}": 1_052_632 for n in range(19)}
    weights = {s: n**mixing.TEMPER for s, n in rows.items()}
    sizes = {s: int(20 * mixing.ROUND * w / sum(weights.values())) for s, w in weights.items()}
    placed = list(mixing.timed(weights, sizes))
    assert sorted((s, k) for s, k, _ in placed) == sorted((s, k) for s, n in sizes.items() for k in range(n))
    assert drift(placed, weights, sizes) < 1


def test_light_sources_keep_their_weight():
    weights, sizes = {"a": 1.0, "b": 1e-4}, {"a": 25_000, "b": 3}
    placed = list(mixing.timed(weights, sizes))
    assert drift(placed, weights, sizes) < 1 and sum(s == "b" and slot < 10_000 for s, _, slot in placed) <= 2


def test_blocks_of_a_very_light_source_end_the_schedule_soon():
    placed = list(mixing.timed({"a": 1.0, "b": 1e-12}, {"a": 5, "b": 3}))
    assert len(placed) == 8 and len({slot for _, _, slot in placed}) == 8


def test_more_sources_than_a_round_has_slots(spark):
    docs = spark.range(2_400).selectExpr("id as doc_id", "concat('s', id % 1200) as source")
    placed = mixing.mixed(docs).collect()
    assert len(placed) == 2_400 and len({r["position"] for r in placed}) == 2_400


def test_given_weights_hold_over_the_table(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source")
    weights = {"a": 1 / 3, "b": 2 / 3}
    placed = {(r["source"], r["slot"]) for r in mixing.mixed(docs, weights, block=4).select("source", "slot").collect()}
    sizes = {s: sum(x == s for x, _ in placed) for s in weights}
    assert drift([(s, 0, slot) for s, slot in placed], weights, sizes) < 1
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"a": 1.0})
