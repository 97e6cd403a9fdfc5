"""Runs of several sources: counts, statuses, isolation, marks and restarts."""

import datetime as dt

from pyspark.sql import functions as F

from feedloom.operators import fleet

SCHEMA = "external_id string, record_type string, body string, at timestamp, error string"
DAY = dt.datetime(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def given(rows):
    """A source that gives its rows past the mark; rows without a time always."""
    return lambda spark, mark: spark.createDataFrame([r for r in rows if mark is None or r[3] is None or r[3] > mark], SCHEMA)


def item(n, at=None):
    return (f"e{n}", "post", f"body {n}", day(n) if at is None else at, None)


def told(df):
    return {r["source"]: (r["status"], r["failure_code"], r["discovered"], r["stored"], r["failed"], r["mark"]) for r in df.collect()}


def broken(spark, mark):
    raise RuntimeError("no credentials")


def breaks_in_a_task(spark, mark):
    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("gone"))).otherwise(F.lit("x"))
    return spark.range(10).select(F.col("id").cast("string").alias("external_id"), F.lit("post").alias("record_type"), bad.alias("body"), F.lit(DAY).alias("at"), F.lit(None).cast("string").alias("error"))


def test_each_source_has_its_own_end(spark, tmp_path):
    cut = (None, None, None, None, "rate_limited")
    sources = {
        "whole": given([item(1), item(2), item(3)]),
        "partly": given([item(1), ("", "post", "b", day(9), None), ("e5", None, "b", day(9), None)]),
        "none_whole": given([(None, "post", "b", day(2), None)]),
        "cut_off": given([item(4), item(2), cut, cut]),
        "cut_at_once": given([cut]),
        "empty": given([]),
        "raises": broken,
        "task": breaks_in_a_task,
    }
    found = told(fleet.run_fleet(spark, sources, str(tmp_path)))
    task = found.pop("task")
    assert task[0] == "failed" and task[1] and task[2:] == (0, 0, 0, None)
    assert found == {
        "whole": ("completed", None, 3, 3, 0, day(3)),
        "partly": ("partially_completed", None, 3, 1, 2, day(1)),
        "none_whole": ("failed", "ALL_ITEMS_FAILED", 1, 0, 1, None),
        "cut_off": ("partially_completed", None, 2, 2, 1, day(4)),
        "cut_at_once": ("failed", "rate_limited", 0, 0, 1, None),
        "empty": ("completed", None, 0, 0, 0, None),
        "raises": ("failed", "RuntimeError", 0, 0, 0, None),
    }
    assert fleet.runs(spark, str(tmp_path)).count() == len(sources)
    items = fleet.landed_items(spark, str(tmp_path))
    assert {(r["source"], r["n"]) for r in items.groupBy("source").agg(F.count("*").alias("n")).collect()} == {("whole", 3), ("partly", 1), ("cut_off", 2)}
    assert sorted(r["broken"] for r in fleet.landed_items(spark, str(tmp_path), whole=False).collect()) == ["missing_id", "missing_id", "missing_type", "rate_limited", "rate_limited"]


def test_a_second_run_goes_on_from_what_was_stored(spark, tmp_path):
    folder = str(tmp_path)
    first = {"a": given([item(1), item(2)]), "b": given([item(5)])}
    fleet.run_fleet(spark, first, folder)
    second = {"a": given([item(1), item(2), item(3), ("", "post", "b", day(8), None)]), "b": broken}
    found = told(fleet.run_fleet(spark, second, folder))
    # the broken item of day 8 moves no mark; b keeps the one it had
    assert found == {"a": ("partially_completed", None, 2, 1, 1, day(3)), "b": ("failed", "RuntimeError", 0, 0, 0, day(5))}
    third = {"a": given([item(n) for n in (1, 2, 3)]), "b": given([item(5), item(6)])}
    assert told(fleet.run_fleet(spark, third, folder)) == {"a": ("completed", None, 0, 0, 0, day(3)), "b": ("completed", None, 1, 1, 0, day(6))}
    stored = sorted((r["source"], r["external_id"]) for r in fleet.landed_items(spark, folder).collect())
    assert stored == [("a", "e1"), ("a", "e2"), ("a", "e3"), ("b", "e5"), ("b", "e6")]
    assert fleet.marks(spark, folder) == {"a": day(3), "b": day(6)}


def test_a_run_that_died_is_not_read_and_is_collected_again(spark, tmp_path):
    folder = str(tmp_path)
    # items are there, the row of the run isn't
    given([item(1)])(spark, None).withColumn("broken", F.lit(None).cast("string")).withColumn("whole", F.lit(True)).write.partitionBy("whole").parquet(f"{folder}/items/dead")
    assert fleet.landed_items(spark, folder) is None and fleet.marks(spark, folder) == {}
    assert told(fleet.run_fleet(spark, {"a": given([item(1)])}, folder)) == {"a": ("completed", None, 1, 1, 0, day(1))}
    assert fleet.landed_items(spark, folder).count() == 1


def test_a_source_that_outlasts_the_ceiling_is_cut_off(spark, tmp_path):
    def slow(spark, mark):
        wait = F.udf(lambda n: __import__("time").sleep(30) or str(n))
        return spark.range(2).select(wait("id").alias("external_id"), F.lit("post").alias("record_type"), F.lit("b").alias("body"), F.lit(DAY).alias("at"), F.lit(None).cast("string").alias("error"))

    found = told(fleet.run_fleet(spark, {"slow": slow, "whole": given([item(1)])}, str(tmp_path), ceiling=6))
    assert found == {"slow": ("failed", "TimeoutError", 0, 0, 0, None), "whole": ("completed", None, 1, 1, 0, day(1))}
