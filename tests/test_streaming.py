"""Streams against the same work on the whole table."""

import datetime as dt

import pytest

from feedloom.streaming import incremental as inc

EVENTS = "/root/testdata/sf0.001/events.parquet"
ITEM = "source string, external_id long, checksum string, at long"


def landed(spark, folder, batches):
    """One file for each batch, read one file at a time."""
    for rows in batches:
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(str(folder))


def test_upserts_keep_the_newest_row_of_each_key(spark, tmp_path):
    batches = [
        [("s", n, f"a{n}", 1) for n in range(50)],
        [("s", 3, "b3", 2), ("s", 3, "c3", 3), ("s", 60, "a60", 1), ("t", 3, "t3", 1)],
        [("s", 4, "a4", 9), (None, 5, "n5", 1)],
    ]
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for n, rows in enumerate(batches):
        landed(spark, tmp_path / "in", [rows])
        inc.upsert_stream(inc.read_stream(spark, str(tmp_path / "in"), ITEM), table, checkpoint, ["source", "external_id"], "at", parts=8).awaitTermination()
        assert (tmp_path / "table" / "rows" / f"batch={n}").exists()
    found = {(r["source"], r["external_id"]): (r["checksum"], r["at"]) for r in inc.upserts(spark, table).collect()}
    assert len(found) == 53 and found["s", 3] == ("c3", 3) and found["t", 3] == ("t3", 1) and found["s", 60] == ("a60", 1)
    # the same checksum again changes nothing
    assert found["s", 4] == ("a4", 1) and found[None, 5] == ("n5", 1)


def test_a_batch_writes_only_the_parts_of_its_keys(spark, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for rows in ([("s", n, "a", 1) for n in range(200)], [("s", 7, "b", 2)]):
        landed(spark, tmp_path / "in", [rows])
        inc.upsert_stream(inc.read_stream(spark, str(tmp_path / "in"), ITEM), table, checkpoint, ["source", "external_id"], "at").awaitTermination()
    parts = lambda n: list((tmp_path / "table" / "rows" / f"batch={n}").glob("part=*"))
    assert len(parts(1)) == 1 < len(parts(0)) <= inc.PARTS
    assert inc.upserts(spark, table).count() == 200


def run(spark, df, mode, name):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("slide", [None, "12 hours"])
def test_windows_equal_those_of_the_whole_table(spark, slide):
    batch = spark.read.parquet(EVENTS).withColumn("ts", _stamp("ts"))
    stream = spark.readStream.schema(spark.read.parquet(EVENTS).schema).parquet(EVENTS.replace("events", "event[s]")).withColumn("ts", _stamp("ts"))
    rows = lambda df: sorted((r["w"]["start"], r["w"]["end"], r["event_type"], r["events"], round(r["total"], 6)) for r in df.collect())
    found = run(spark, inc.tumbling(stream, "1 day", "1 hour", slide), "complete", f"windows_{slide is None}".lower())
    assert rows(found) == rows(inc.tumbling(batch, "1 day", "1 hour", slide)) and found.count() > 30


def test_sessions_end_at_the_gap(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=minute)
    rows = [(1, at(0)), (1, at(9)), (1, at(18)), (1, at(40)), (2, at(5)), (3, at(1000))]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = inc.read_stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp")
    found = run(spark, inc.sessions(stream, "10 minutes", "1 minute"), "complete", "sessions").collect()
    assert sorted((r["user_id"], r["w"]["start"], r["events"]) for r in found) == [(1, at(0), 3), (1, at(40), 1), (2, at(5), 1), (3, at(1000), 1)]


def test_a_hash_passes_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    for n, hashes in enumerate((["x", "y", "x"], ["y", "z"])):
        spark.createDataFrame([(h, at) for h in hashes], "hash string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = inc.read_stream(spark, str(tmp_path / "in"), "hash string, at timestamp", files=1)
    assert sorted(r["hash"] for r in run(spark, inc.first_of_hash(stream, "hash", "at"), "append", "hashes").collect()) == ["x", "y", "z"]


def _stamp(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("timestamp")
