"""The source of stored feeds: what snapshots tell, marks, the stream's restarts."""

from datetime import UTC, datetime
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from feedloom.sources import feeds, landing

RSS = '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title><link>https://a.example</link>{}</channel></rss>'


def item(n, at=None, extra=""):
    time = f"<pubDate>{at:%a, %d %b %Y %H:%M:%S} +0000</pubDate>" if at else ""
    return f"<item><title>T{n}</title><link>https://a.example/{n}</link><description>&lt;p&gt;body {n}&lt;/p&gt;</description>{time}{extra}</item>"


def day(n):
    return datetime(2024, 1, n, 12, tzinfo=UTC)


def land(root, feed, snapshot, content):
    folder = root / f"feed={quote(feed, safe='')}" / f"snapshot={snapshot}"
    folder.mkdir(parents=True)
    (folder / "part-0.xml").write_text(content, encoding="utf-8")


def read(spark, root):
    return feeds.registered(spark).read.format("feeds").load(str(root))


def test_an_rss_snapshot_has_the_item_columns(spark, tmp_path):
    land(tmp_path, "https://a.example/f?x=1", "001", RSS.format(item(1, day(3), "<dc:creator>Ann</dc:creator>") + item(2) + "<item><title>no link</title></item>"))
    df = read(spark, tmp_path)
    assert df.columns == feeds.COLUMNS and len(df.columns) == 19
    one, two = df.orderBy("source_url").collect()
    assert (one["title"], one["body"], one["source_url"], one["record_type"]) == ("T1", "body 1", "https://a.example/1", "article_passage")
    assert one["metadata"] == {"feed_url": "https://a.example/f?x=1", "author_display_name": "Ann", "snapshot": "001"}
    assert two["published_at"] is None and two["rating"] is None


def test_equals_the_projection_of_landed_entries(spark, tmp_path):
    land(tmp_path, "f", "1", RSS.format("".join(item(n, day(n)) for n in range(1, 6))))
    rows = [(f"https://a.example/{n}", f"T{n}", f"<p>body {n}</p>", f"2024-01-{n:02}T12:00:00Z", None, "f") for n in range(1, 6)]
    want = landing.feed_articles(spark.createDataFrame(rows, landing.SCHEMAS["quickcommerce"]))
    got = read(spark, tmp_path).withColumn("metadata", F.map_filter("metadata", lambda k, v: k != "snapshot"))
    plain = lambda df: sorted(r.asDict()["external_id"] + repr(r) for r in df.collect())
    assert plain(got) == plain(want)


def test_atom_entries(spark, tmp_path):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><link href="https://a.example/"/><entry><title>One</title><link rel="edit" href="https://a.example/edit"/><link href="https://a.example/one"/>
    <updated>2024-01-05T10:00:00+02:00</updated><summary type="html">&lt;b&gt;x&lt;/b&gt; y</summary><author><name>Bo</name></author></entry></feed>"""
    land(tmp_path, "atom", "1", atom)
    r = read(spark, tmp_path).first()
    assert (r["source_url"], r["title"], r["body"], r["metadata"]["author_display_name"]) == ("https://a.example/one", "One", "x y", "Bo")
    assert read(spark, tmp_path).select(F.unix_timestamp("published_at")).first()[0] == 1704441600


def test_broken_empty_and_hidden_snapshots(spark, tmp_path):
    land(tmp_path, "broken", "1", RSS.format(item(1) + item(2)).replace("</channel></rss>", "<item><title>&"))
    land(tmp_path, "none", "1", "no feed at all")
    land(tmp_path, "empty", "1", "")
    (tmp_path / "feed=broken" / "snapshot=1" / "_begun.xml").write_text(RSS.format(item(3)))
    assert {r["title"] for r in read(spark, tmp_path).collect()} == {"T1", "T2"}
    assert read(spark, tmp_path / "missing").count() == 0


@pytest.mark.parametrize(("told", "want"), [("Wed, 03 Jan 2024 12:00:00 GMT", day(3)), ("2024-01-03T12:00:00Z", day(3)), ("2024-01-03T14:00:00+02:00", day(3)), ("2024-01-03 12:00:00", day(3)), ("soon", None), ("", None), (None, None), ("31 Feb 2024", None)])
def test_times(told, want):
    assert feeds.when(told) == want


def test_a_snapshot_raises_the_mark_for_the_next(spark, tmp_path):
    land(tmp_path, "a", "1", RSS.format(item(1, day(1)) + item(5, day(5))))
    land(tmp_path, "a", "2", RSS.format(item(4, day(4)) + item(5, day(5)) + item(6, day(6)) + item(7)))
    land(tmp_path, "b", "1", RSS.format(item(3, day(3)) + item(4, day(4))))
    marks = spark.createDataFrame([("b", day(3)), ("silent", day(9))], "feed string, mark timestamp")
    kept, after = feeds.fresh(read(spark, tmp_path), marks)
    assert sorted((r["metadata"]["feed_url"], r["title"]) for r in kept.collect()) == [("a", "T1"), ("a", "T5"), ("a", "T6"), ("a", "T7"), ("b", "T4")]
    days = {r["feed"]: r["d"] for r in after.select("feed", F.dayofmonth("mark").alias("d")).collect()}
    assert days == {"a": 6, "b": 4, "silent": 9}


def run(spark, root, folder):
    feeds.collected(spark, str(root), str(folder)).awaitTermination()
    return sorted((r["batch"], r["metadata"]["feed_url"], r["title"]) for r in spark.read.parquet(f"{folder}/items").collect())


def test_a_restart_reads_nothing_twice(spark, tmp_path):
    root, out = tmp_path / "feeds", tmp_path / "out"
    assert feeds.marks_of(spark, str(out)).count() == 0
    land(root, "a", "1", RSS.format(item(1, day(1)) + item(2, day(2)) + item(9)))
    first = run(spark, root, out)
    assert first == [(0, "a", "T1"), (0, "a", "T2"), (0, "a", "T9")]
    assert run(spark, root, out) == first
    land(root, "a", "2", RSS.format(item(2, day(2)) + item(3, day(3))))
    land(root, "b", "0", RSS.format(item(1, day(1))))
    assert run(spark, root, out) == [*first, (1, "a", "T3"), (1, "b", "T1")]
    assert {r["feed"] for r in feeds.marks_of(spark, str(out)).collect()} == {"a", "b"}


def test_a_batch_that_failed_is_repeated_whole(spark, tmp_path):
    root, out = tmp_path / "feeds", tmp_path / "out"
    land(root, "a", "1", RSS.format(item(1, day(1))))
    run(spark, root, out)
    land(root, "a", "2", RSS.format(item(1, day(1)) + item(2, day(2))))
    want = run(spark, root, out)
    # as if the driver had been lost after the batch's writes and before its commit
    (out / "state" / "commits" / "1").unlink()
    for crc in (out / "state" / "commits").glob(".1.crc"):
        crc.unlink()
    assert run(spark, root, out) == want == [(0, "a", "T1"), (1, "a", "T2")]


def test_landed_snapshots_are_moved_by_the_tasks(spark, tmp_path):
    """One whole file for each snapshot, no committer's traces; a repeated task doubles nothing."""
    odd = "https://a.example/f?x=1&y=%2F é"
    rows = spark.createDataFrame([(odd, "1", RSS.format(item(1, day(1)))), ("b", "0/1", RSS.format(item(2))), ("b", "2", "é")], "feed string, snapshot string, value string")
    for _ in range(2):
        feeds.land(rows, str(tmp_path / "r"))
    assert [(s.feed, s.snapshot) for s in feeds.snapshots(str(tmp_path / "r"))] == [("b", "0/1"), ("b", "2"), (odd, "1")]
    assert all(p.suffix == ".xml" for p in (tmp_path / "r").rglob("*") if p.is_file())
    assert sorted((r["metadata"]["feed_url"], r["title"]) for r in read(spark, tmp_path / "r").collect()) == [("b", "T2"), (odd, "T1")]
