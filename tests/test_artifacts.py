"""The artifact sink: names by content, commit and abort, repeats, the size cap, and reading back."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from feedloom.sources import artifacts

SCHEMA = "source string, run string, captured_at timestamp, content string, extension string"
AT = dt.datetime(2024, 3, 5, 23, 30)


def items(spark, rows, parts=3):
    return artifacts.registered(spark).createDataFrame(rows, SCHEMA).repartition(parts)


def save(df, folder, **options):
    df.write.format("artifacts").mode("append").options(**options).save(str(folder))


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*") if p.is_file()} if folder.exists() else {}


def key(source, run, content, extension="json"):
    return f"raw/{source}/2024/03/05/{run}/{hashlib.sha256(content.encode()).hexdigest()}.{extension}"


def test_items_stand_under_their_content(spark, tmp_path):
    rows = [("a", "r1", AT, f'{{"n": {n}}}', None) for n in range(40)] + [("b", "r2", AT, "<p>é</p>", "html"), ("a", "r1", AT, '{"n": 3}', "json")]
    df, root = items(spark, rows), tmp_path / "store"
    save(df, root)
    assert set(files(root)) == {key(s, r, c, e or "json") for s, r, _, c, e in rows}
    rows = artifacts.described(df)
    assert {r["storage_key"] for r in rows.collect()} == set(files(root)) and rows.where("problem is not null").isEmpty()
    assert {r["found"] for r in artifacts.verified(rows, str(root)).collect()} == {"ok"}
    assert rows.where("source = 'b'").first()["byte_size"] == 9


def test_a_repeat_writes_nothing_and_more_items_join_the_run(spark, tmp_path):
    root = tmp_path / "store"
    first = [("a", "r1", AT, f"x{n}", None) for n in range(10)]
    save(items(spark, first), root)
    before = files(root)
    save(items(spark, first), root)
    assert files(root) == before
    save(items(spark, [*first, ("a", "r1", AT, "new", None), ("a", "r2", AT, "x1", None)]), root)
    after = files(root)
    assert set(after) - set(before) == {key("a", "r1", "new"), key("a", "r2", "x1")} and all(after[k] == t for k, t in before.items())


@pytest.mark.parametrize("bad", [("a", "r1", AT, "y" * 2000, None), ("a", "../r1", AT, "y", None), ("a", "r1", AT, "", None), ("a", "r1", None, "y", None), (None, "r1", AT, "y", None)])
def test_an_aborted_job_leaves_nothing(spark, tmp_path, bad):
    root = tmp_path / "store"
    rows = [("a", "r1", AT, f"x{n}", None) for n in range(30)]
    with pytest.raises(Exception, match="bytes, of 1 to|no name can be made"):
        save(items(spark, [*rows, bad], parts=4), root, most_bytes="1000")
    assert files(root) == {} and not (root / artifacts.STAGING).exists()
    save(items(spark, rows), root, most_bytes="1000")
    assert len(files(root)) == 30


def test_what_the_sink_refuses_is_told_before(spark):
    rows = [("a", "r1", AT, "ok", None), ("a", "r1", AT, "y" * 11, None), ("a", "r1", AT, None, None), ("a", None, AT, "y", None)]
    found = artifacts.described(spark.createDataFrame(rows, SCHEMA), most_bytes=10)
    assert [r["problem"] for r in found.collect()] == [None, "too_large", "empty", "missing"]


def test_spoiled_and_missing_files_are_found(spark, tmp_path):
    root = tmp_path / "store"
    df = items(spark, [("a", "r1", AT, c, None) for c in ("one", "two", "three")])
    save(df, root)
    (root / key("a", "r1", "one")).write_text("eno")
    (root / key("a", "r1", "two")).unlink()
    found = {r["storage_key"]: r["found"] for r in artifacts.verified(artifacts.described(df), str(root)).collect()}
    assert [found[key("a", "r1", c)] for c in ("one", "two", "three")] == ["differs", "missing", "ok"]
    assert spark.range(1).select(artifacts.content_of("id").alias("c"), F.lit(1)).first()["c"] == '{"id":0}'


def test_nothing_to_write_and_no_overwriting(spark, tmp_path):
    save(items(spark, []), tmp_path / "none")
    assert files(tmp_path / "none") == {}
    with pytest.raises(Exception, match="never overwritten"):
        items(spark, [("a", "r", AT, "x", None)]).write.format("artifacts").mode("overwrite").save(str(tmp_path / "none"))
    with pytest.raises(Exception, match="missing: run"):
        items(spark, []).drop("run").write.format("artifacts").mode("append").save(str(tmp_path / "none"))
