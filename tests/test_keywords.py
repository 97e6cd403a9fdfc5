"""Keyword search over stored postings, against a plain walk over the words."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from feedloom.operators import keywords

RECORDS, QUESTIONS = "record_id long, text string", "question_id long, text string"


def plain_score(text, asked):
    """Every interval of words is tried: a cover that holds no shorter one counts."""
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    asked = set(asked)
    covers = [(a, b) for a, b in product(range(len(w)), repeat=2) if a <= b and asked <= set(w[a : b + 1])]
    small = [(a, b) for a, b in covers if not any((c, d) != (a, b) and a <= c and d <= b for c, d in covers)]
    return sum(keywords.SCALE // (b - a + 1) for a, b in small) / keywords.SCALE


def plain_search(records, questions, most):
    out = []
    for q, text in questions:
        asked = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
        scores = sorted((-plain_score(t, asked), r) for r, t in records if asked and r is not None)
        out += [(q, n, r, -s) for n, (s, r) in enumerate([x for x in scores if x[0] < 0][:most], 1) if q is not None]
    return sorted(out)


def stock(spark, folder, *batches):
    for rows in batches:
        keywords.write(spark.createDataFrame(rows, RECORDS), str(folder), parts=4, splits=2)
    return keywords.read(spark, str(folder))


def search(spark, found, questions, most=40):
    got = keywords.search(found, spark.createDataFrame(questions, QUESTIONS), most, parts=4)
    return sorted(tuple(r) for r in got.select("question_id", "place", "record_id", "score").collect())


def test_places(spark):
    rows = [(1, "A b, a! B a"), (2, ""), (3, None), (None, "a"), (4, "É_1 é")]
    got = keywords.postings(spark.createDataFrame(rows, RECORDS))
    assert sorted((r["term"], r["record_id"], r["places"]) for r in got.collect()) == [("1", 4, [1]), ("a", 1, [0, 2, 4]), ("b", 1, [1, 3]), ("é", 4, [0, 2])]


@pytest.mark.parametrize("most", [3, 40])
def test_equals_a_plain_walk(spark, tmp_path, most):
    rng = random.Random(7)
    letters = "abcdefgh"
    records = [(i, " ".join(rng.choices(letters, weights=[8, 6, 4, 3, 2, 1, 1, 1], k=rng.randint(0, 18)))) for i in range(120)]
    questions = [(i, " ".join(rng.choices(letters, k=rng.randint(0, 4)))) for i in range(40)]
    found = stock(spark, tmp_path / "p", records[:70], records[70:])
    assert search(spark, found, questions, most) == plain_search(records, questions, most)


def test_odd_rows(spark, tmp_path):
    long = "x " * 30_000 + "end"
    records = [(1, "tea milk"), (2, "milk with tea"), (3, None), (4, ""), (None, "tea milk"), (5, long), (6, "milk tea")]
    found = stock(spark, tmp_path / "p", records)
    questions = [(1, "Tea, tea MILK"), (2, None), (3, "?!"), (None, "tea"), (4, "absent tea"), (5, "x end"), (6, "Tea, tea MILK")]
    want = [(1, 1, 1, 0.5), (1, 2, 6, 0.5), (1, 3, 2, round(1 / 3, 9))]
    assert search(spark, found, questions) == sorted([*want, (5, 1, 5, 0.5), *((6, *w[1:]) for w in want)])
    assert search(spark, found, []) == []


def test_a_search_reads_postings_of_its_terms_parts_only(spark, tmp_path):
    rows = [(i, f"w{i} w{i % 7} shared") for i in range(300)]
    found = stock(spark, tmp_path / "p", rows)
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == [f"part={n}" for n in range(4)]
    got = keywords.search(found, spark.createDataFrame([(1, "w250 w250")], QUESTIONS), parts=4)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 250, 1.0)]
    mine = spark.range(1).select(keywords._part(F.lit("w250"), 4)).first()[0]
    for n in set(range(4)) - {mine}:
        for file in (tmp_path / "p" / f"part={n}").glob("*.parquet"):
            file.unlink()
    again = keywords.search(keywords.read(spark, str(tmp_path / "p")), spark.createDataFrame([(1, "w250")], QUESTIONS), parts=4)
    assert [tuple(r) for r in again.collect()] == [(1, 1, 250, 1.0)]


def test_the_stock_is_not_read_again_for_each_join(spark, tmp_path):
    """What the asked words have is put aside once: the search's joins read that and not all postings."""
    found = stock(spark, tmp_path / "p", [(i, f"w{i} shared") for i in range(20)])
    got = keywords.search(found, spark.createDataFrame([(1, "w7 shared")], QUESTIONS), parts=4)
    assert not [f for f in got.inputFiles() if str(tmp_path / "p") in f]
    assert [tuple(r) for r in got.collect()] == [(1, 1, 7, 0.5)]
