"""Divergence and the two searches on odd rows, against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedloom.llm import divergence, lexical_search, terms, vector_search

DOCS = "doc_id long, text string, lang string, source string, term string, n long, p long, value long, score long, rank int"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", -1, -1, -1, -1, -1) for r in rows], DOCS)


def lowered(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_audit(rows, fewest, ranks=10):
    langs = defaultdict(list)
    for _, text, lang, source in rows:
        langs[lang or ""].append((source or "", lowered(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")))
    out = []
    for lang, docs in langs.items():
        kept = sorted(t for t, n in Counter(t for _, words in docs for t in set(words)).items() if n >= fewest)
        counts = {s: Counter(t for x, words in docs if x == s for t in words if t in set(kept)) for s in {s for s, _ in docs}}
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        shares, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in counts if o != s]
            told = [(f(shares[s][t], q[t]), t) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", told)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(found) if part == "pair" or n < ranks]
    return sorted(out)


def plain_search(rows, items, most):
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    docs = [(i, Counter(lowered(text, word))) for i, text, *_ in rows]
    filled, tokens = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked, found = lowered(text, word), []
        for doc_id, c in docs:
            m = 75 + 25 * c.total() * filled // tokens
            score = sum(math.floor(1000 * math.log((2 * filled + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, -math.inf if doc_id is None else doc_id, doc_id))
        out += [(item, n + 1, doc_id, -score) for n, (score, _, doc_id) in enumerate(sorted(found, key=lambda x: x[:2])[:most])]
    return sorted(out, key=repr)


ODD = (
    [(n, f"Alpha beta{n % 3} Gamma-gamma ÄÖ delta" if n % 2 else f"alpha {'zeta ' * (n % 7)}x1y", "en", f"s{n % 5}") for n in range(60)]
    + [(None, "alpha beta", None, None), (7, None, "en", "s9"), (8, "", "fr", "s1"), (8, "", "fr", "s2"), (9, " .,; ", None, "s1"), (9, "alpha", "en", "s0"), (9, "alpha", "en", "s0")]
    + [(100 + n, "same copy of alpha", "en", "hot") for n in range(40)]
)


@pytest.mark.parametrize("held", [1 << 18, 3])
def test_audit(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    got = divergence.audited(frame(spark, ODD), fewest=4, ranks=3).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == plain_audit(ODD, 4, 3)
    assert {r[2] for r in got} == {"pair", "term"}


def test_a_task_hands_its_counts_on_as_few_rows(spark):
    """Over half of 2^18 different terms twice: one row a term and source, also of bytes that aren't UTF-8."""
    words = [f"w{'abcdefghij'[n % 10]}{n:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for n in range(140_000)]
    rows = [(n, " ".join(words), "en", f"s{n % 2}") for n in range(4)]
    docs = frame(spark, rows).select("text", "lang", "source").coalesce(1)
    got = divergence.partial_counts(docs).groupBy("source").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()
    terms_of = len(set(words))
    assert sorted(map(tuple, got)) == [(s, terms_of, 2 * len(words), 2 * terms_of) for s in ("s0", "s1")]
    broken = spark.sql("select cast(X'616220FF6320FF63' as string) as text, 'en' as lang, 's' as source")
    assert sorted((r["term"], r["n"]) for r in divergence.partial_counts(broken).collect()) == [("ab", 1), ("\ufffdc", 2)]


def test_audit_of_nothing(spark):
    assert divergence.audited(frame(spark, ODD[:0])).count() == 0
    alone = divergence.audited(frame(spark, [(1, "a b", "en", "s"), (2, None, "en", "t")])).collect()
    assert sorted(map(tuple, alone)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_large_counts_stay_exact(spark):
    """Long products would overflow from about 9 * 10^9 occurrences on."""
    n, total, kept = 123_456_789_012_345, 987_654_321_098_765, 4_321
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, v long").select(divergence.share("n", "total", "v")).first()
    assert row[0] == 1 + 1_000_000_000 * (n + 2) // (total + 2 * kept)


ITEMS = [(1, "alpha zeta"), (2, "same copy of alpha alpha"), (3, None), (4, " ,. "), (5, "unknown"), (6, "gamma äö ÄÖ x1y"), (None, "delta")]


@pytest.mark.parametrize("docs,trees,fan", [(4_096, 1_024, 16), (7, 2, 2), (1, 1, 3)])
def test_lexical_search(spark, monkeypatch, docs, trees, fan):
    monkeypatch.setattr(lexical_search, "RANGE_DOCS", docs)
    monkeypatch.setattr(lexical_search, "TREES", trees)
    monkeypatch.setattr(lexical_search, "FAN", fan)
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, doc_id long")
    got = lexical_search.searched(frame(spark, ODD), items, most=12).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(ODD, ITEMS, 12)


def test_lexical_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 10)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical_search.searched(frame(spark, ODD), items, most=5).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(ODD, ITEMS, 5)


def test_lexical_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.searched(frame(spark, ODD[:0]), items).count() == 0
    assert lexical_search.searched(frame(spark, [(1, " . ", "en", "s"), (2, None, "en", "s")]), items).count() == 0
    assert lexical_search.searched(frame(spark, ODD), items.limit(0)).count() == 0
    assert lexical_search.searched(frame(spark, ODD), items.where("item_id = 4")).count() == 0


def test_bounds_spare_nodes():
    """A term of one document leads to it without opening the whole tree."""
    n = 1_000
    row = {"ids": list(range(n)), "lengths": [50] * n, "terms": ["common", "rare"], "first": np.array([0, n, n + 1]), "docs": np.array([*range(n), 700]), "tfs": np.ones(n + 1, np.int64)}
    part = lexical_search.Range(row, {"common": 10, "rare": 5_000}, n, 50 * n)
    best, opened = part.best({"common": 1, "rare": 1}, 1, 1)
    assert best[0][1] == 700 and opened == 3
    every, opened = part.best({"common": 1}, 1, 1)
    assert every[0][1] == 0 and opened == 1 + 4 + 63  # all are equal, so all are opened for the least id


def test_an_index_of_many_ranges_is_read_by_small_row_groups(spark, monkeypatch):
    """What a reader or writer holds at once doesn't follow the ranges of a task."""
    monkeypatch.setattr(lexical_search, "RANGE_DOCS", 1)
    rng = np.random.default_rng(4)
    rows = [(n, " ".join(f"w{x:x}" for x in rng.integers(0, 1 << 60, 20_000)) + " twice" * (300 * (n % 3)), "en", "s") for n in range(60)]
    index = lexical_search.stored(frame(spark, rows).coalesce(1))
    groups = [(m.row_group(k).num_rows, m.row_group(k).total_byte_size) for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for k in range(m.num_row_groups)]
    assert sum(n for n, _ in groups) == 60 and len(groups) > 1 and max(size for _, size in groups) < 16 << 20
    items = spark.createDataFrame([(1, "twice")], "item_id long, text string")
    got = lexical_search.searched(frame(spark, rows), items, most=50).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(rows, [(1, "twice")], 50)


def test_long_texts_are_cut_between_terms(monkeypatch):
    table = terms.alphabet(digits=True)
    text = ("Ab1 " * 50 + "ç" * 40 + " end").encode()
    whole = list(terms.pieces(text, table))
    monkeypatch.setattr(terms, "PIECE", 10)
    cut = list(terms.pieces(text, table))
    assert len(cut) > 5 and [w for p in cut for w in p] == whole[0]


def plain_vectors(rows, every, most):
    fit = [(n, i, [math.floor(64 * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in fit:
        if i is not None and i % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, j) for k, j, w in fit if k != n and len(w) == len(v)]
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(found, key=lambda x: x[:2])[:most])]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "vec_id long, embedding array<double>, row long, pivot long, x string")


@pytest.mark.parametrize("ring,shelf", [(256, 1 << 20), (3, 40)])
def test_vector_search(spark, monkeypatch, ring, shelf):
    monkeypatch.setattr(vector_search, "RING", ring)
    monkeypatch.setattr(vector_search, "SHELF", shelf)
    monkeypatch.setattr(vector_search, "HITS", 50)
    rng = np.random.default_rng(3)
    rows = [(n, (rng.normal(size=4) * rng.choice([0.1, 1, 9])).tolist()) for n in range(150)]
    rows += [(1_000 + n, [0.5, 0.5, 0.5, 0.5]) for n in range(60)]  # a group of copies
    rows += [(40, [0.1, 0.2, 0.3, 0.4]), (40, [0.1, 0.2, 0.3, 0.4]), (None, [5.0, 5.0, 5.0, 5.0]), (20, None), (60, [float("nan"), 1.0, 1.0, 1.0]), (80, [None, 1.0, 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(-20, [1.0, 2.0]), (3, [2.0, -1.0]), (120, [7.0]), (140, []), (5, []), (160, [0.0, 0.0, 0.0, 0.0])]
    got = vector_search.searched(vectors(spark, rows), most=7).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == plain_vectors(rows, 20, 7)


def test_vector_search_of_nothing(spark):
    assert vector_search.searched(vectors(spark, [])).count() == 0
    assert vector_search.searched(vectors(spark, [(20, None), (1, [1.0])])).count() == 0
    assert vector_search.searched(vectors(spark, [(20, [1.0])])).count() == 0


def test_products_beyond_doubles_are_exact():
    q, x = np.array([[1 << 40, 3]]), np.array([[1 << 21, 1], [1 << 40, 0]])
    assert vector_search._products(q, x).tolist() == [[(1 << 61) + 3, (1 << 63) - 1]]


def test_rings_that_cannot_win_are_left_out(spark):
    """Tight groups far apart: a query meets few rings beside its own group's."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16)) * 40
    x = np.floor(64 * (centres[np.arange(5_000) % 10] + rng.normal(size=(5_000, 16)) * 0.05)).astype(np.int64)
    most = float((x**2).sum(1).max())
    found = {16: np.floor(centres * 64)}
    rows = [{"row": n, "vec_id": n, "x": x[n]} for n in range(0, 5_000, 20)]
    block = vector_search.Block(rows, 16, found, most)
    raised = vector_search._raised(x.astype(float), most)
    away = vector_search._apart(raised, vector_search._raised(found[16], most))
    near, least, made = away.argmin(1), np.full(len(rows), -(1 << 63)), 0
    best = vector_search.Best(len(rows), 20, least)
    shelf = lambda p: {"pivot": p, "away": np.sort(away[near == p, p]), "ids": np.flatnonzero(near == p)[np.argsort(away[near == p, p])], "rows": np.flatnonzero(near == p)[np.argsort(away[near == p, p])], "x": x[np.flatnonzero(near == p)[np.argsort(away[near == p, p])]].ravel()}
    for p in range(10):
        made += block.expand(shelf(p), best, np.flatnonzero(block.home == p))
    seeded = vector_search.Best(len(rows), 20, best.least)
    made = sum(block.expand(shelf(p), seeded, np.arange(len(rows))) for p in range(10))
    q, s, i = seeded.settle()
    want = np.sort((x[::20] @ x.T) - (np.eye(5_000, dtype=np.int64)[::20] << 60), axis=1)[:, ::-1][:, :20]
    assert (s.reshape(-1, 20) == want).all()
    assert made < 0.3 * len(rows) * 5_000
