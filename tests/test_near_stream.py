"""Near-duplicates of a stream against the same work on the whole table."""

import datetime as dt
import random

import pytest

from feedloom.operators import records as rec
from feedloom.streaming import near_stream
from feedloom.streaming.incremental import read_stream
from tests.test_duplicates import drifting

SCHEMA = "record_id long, connector string, normalized string, at timestamp"
DAY = dt.datetime(2024, 1, 1)
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, near_stream.PROVIDER)
    yield
    spark.conf.set(name, before)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def advance(spark, folder, **options):
    """Runs the stream over what has come since, from its checkpoint on; all rows written so far."""
    stream = near_stream.near_duplicate_stream(read_stream(spark, str(folder / "in"), SCHEMA, files=1), "at", **options)
    stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
    return {r["record_id"]: (r["canonical_id"], round(r["similarity"], 6)) for r in spark.read.schema(near_stream.OUT).parquet(str(folder / "out")).collect()}


def test_batches_with_restarts_equal_the_whole(spark, tmp_path):
    rng = random.Random(8)
    texts = [t for _ in range(5) for t in drifting(rng, 24)] + ["short", "", "अ" * 30, "क" * 30]
    rng.shuffle(texts)
    rows = [(i, rng.choice(["a", "b", None]), t, DAY + dt.timedelta(minutes=i)) for i, t in enumerate(texts)]
    whole = spark.createDataFrame(rows, SCHEMA).withColumn("connector", rec.F.coalesce("connector", rec.F.lit("none")))
    want = {r["record_id"]: (r["canonical_id"], round(r["similarity"], 6)) for r in rec.near_duplicates(whole).collect()}
    for start in range(0, len(rows), 45):  # each batch in a query of its own
        arrive(spark, tmp_path, rows[start : start + 45])
        found = advance(spark, tmp_path)
    assert found == want and len(want) > 30
    assert advance(spark, tmp_path) == want  # nothing new came


def test_the_state_is_bounded_and_expires(spark, tmp_path):
    other = lambda n: " ".join(f"other{n}x{k}" for k in range(12))
    arrive(spark, tmp_path, [(1, "a", LONG, DAY), (2, "b", LONG, DAY), (3, "a", other(0), DAY), (4, "a", other(1), DAY)])
    arrive(spark, tmp_path, [(5, "a", LONG, DAY), (6, "b", LONG, DAY), (7, "a", other(1), DAY)])
    found = advance(spark, tmp_path, recent=2)
    assert found == {6: (2, 1.0), 7: (4, 1.0)}  # 1 had left its scope's two places, so 5 is primary
    # 40 days later what was kept for 30 is gone
    arrive(spark, tmp_path, [(8, "c", other(2), DAY + dt.timedelta(days=40))])
    arrive(spark, tmp_path, [(9, "c", other(3), DAY + dt.timedelta(days=40))])
    arrive(spark, tmp_path, [(10, "a", LONG, DAY + dt.timedelta(days=40)), (11, "c", other(2), DAY + dt.timedelta(days=40))])
    assert advance(spark, tmp_path, recent=2, keep=dt.timedelta(days=30)) == found | {11: (8, 1.0)}


def test_late_rows_go_and_repeated_ones_are_no_copies(spark, tmp_path):
    arrive(spark, tmp_path, [(1, "a", LONG, DAY), (1, "a", LONG, DAY), (None, "a", LONG, DAY), (2, "a", LONG, None)])
    arrive(spark, tmp_path, [(3, "b", LONG, DAY + dt.timedelta(days=9))])
    arrive(spark, tmp_path, [(1, "a", LONG, DAY + dt.timedelta(days=9))])
    # 4 is eight days behind, 5 half a day
    arrive(spark, tmp_path, [(4, "a", LONG, DAY + dt.timedelta(days=1)), (5, "a", LONG, DAY + dt.timedelta(days=8.5))])
    assert advance(spark, tmp_path) == {5: (1, 1.0)}


def test_the_store_is_asked_for(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            near_stream.near_duplicate_stream(spark.createDataFrame([], SCHEMA), "at")
    finally:
        spark.conf.set(name, near_stream.PROVIDER)


def test_primaries_of_common_words_are_not_compared():
    """Words that all texts of a scope have find nobody: only the rarest of a text do."""

    class Counted(dict):
        seen = 0

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

    common = [f"a{k:02}" for k in range(40)]
    texts = [tuple(common + [f"own{n}x{k}" for k in range(60)]) for n in range(200)]
    held = near_stream.Primaries(0.85)
    held.held = Counted()
    for n, words in enumerate(texts[:-1]):
        held.add(n, None, words)
    assert held.best(texts[-1]) is None and Counted.seen == 0
    assert held.best(texts[7]) == (1.0, 7) and Counted.seen == 1


def test_primaries_equal_all_comparisons():
    rng = random.Random(3)
    held, kept = near_stream.Primaries(0.85), {}
    for n in range(1500):
        words = tuple(sorted(rng.sample([f"w{k}" for k in range(14)], rng.choice((0, 1, 2, 6, 7, 12, 13)))))
        like = lambda o: len({*words} & {*o}) / len({*words} | {*o}) if words or o else 1.0  # noqa: E731, B023
        assert held.best(words) == max(((like(o), i) for i, o in kept.items() if like(o) >= 0.85), default=None)
        held.add(n, None, words)
        kept[n] = words
        if len(kept) > 20:
            gone = rng.choice(list(kept))
            held.drop(gone)
            del kept[gone]
