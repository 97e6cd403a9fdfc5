"""Near-duplicates chosen in order, against a plain walk over the records."""

import random

from feedloom.operators import likeness
from feedloom.operators import records as rec


def walked(rows):
    """(record_id, canonical_id) of a walk in order: each record meets all earlier primary ones of its connector."""
    primaries, found = {}, {}
    for i, connector, text in sorted(rows):
        if len(text) < rec.LEAST_NEAR:
            continue
        words = set(text.split())
        like = [(len(words & w) / len(words | w), p) for p, w in primaries.get(connector, {}).items()]
        best = max((x for x in like if x[0] >= rec.NEAR), default=None)
        if best:
            found[i] = best[1]
        else:
            primaries.setdefault(connector, {})[i] = words
    return found


def drifting(rng, n):
    """Texts that change word by word, so that likeness goes from one to the next but not far."""
    words, out = [f"w{rng.randrange(500)}" for _ in range(24)], []
    for _ in range(n):
        out.append(" ".join(words))
        for at in rng.sample(range(len(words)), rng.choice([0, 1, 1, 2])):
            words[at] = f"w{rng.randrange(500)}"
    return out


def test_chains_decide_in_order(spark):
    rng = random.Random(4)
    texts = [t for _ in range(6) for t in drifting(rng, 25)] + ["short", "short", ""]
    rng.shuffle(texts)
    rows = [(i, rng.choice(["a", "b"]), t) for i, t in enumerate(texts)]
    want = walked(rows)
    got = rec.near_duplicates(spark.createDataFrame(rows, "record_id long, connector string, normalized string")).collect()
    assert {r["record_id"]: r["canonical_id"] for r in got} == want and len(want) > 40


def test_links_take_exact_copies_first_and_leave_deleted_records_out(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "a", long, "h1", True), (2, "a", long + " thirteen", "h2", False), (3, "b", long + " thirteen", "h2", False), (4, "a", long + " fourteen", "h3", False), (5, "a", long, "h1", False), (6, "a", long, "h1", False)]
    records = spark.createDataFrame(rows, "record_id long, connector string, normalized string, content_hash string, gone boolean").selectExpr("*", "if(gone, timestamp'2024-01-01', null) as deleted_at")
    got = {r["record_id"]: (r["canonical_id"], r["duplicate_type"]) for r in rec.duplicate_links(records).collect()}
    # 2 and 4 share 12 of 14 words; 5 is 12 of 13 of 2, the newest of equals among primaries
    assert got == {3: (2, "cross_source_repost"), 4: (2, "near"), 5: (2, "near"), 6: (5, "exact")}


def test_like_sets_of_any_size_are_found_and_unlike_ones_dont_meet(spark, monkeypatch):
    """Sets small, wide and across that edge, at the bound and under it; most sets share common words. Only what the bits let pass meets whole sets."""
    rng = random.Random(7)
    common, sets = [f"c{i}" for i in range(2_000)], []
    for size in (3, 20, 40, 100, 300, rec.WIDE - 30, rec.WIDE, rec.WIDE + 40, 1_000, 1_600):
        for _ in range(12):
            words = set(rng.sample(common, size))
            sets.append(words)
            for part in (0.03, 0.08, 0.1):
                sets.append(set(rng.sample(sorted(words), size - int(part * size))) | {f"x{rng.random()}" for _ in range(int(part * size * rng.random()))})
    sets = [*{tuple(sorted(s)) for s in sets}, ()]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= rec.NEAR}
    met, was = [], rec.tabled
    monkeypatch.setattr(rec, "tabled", lambda df: met.append(was(df)) or met[-1])
    classes = was(spark.createDataFrame([("s", i, list(w)) for i, w in enumerate(sets)], "scope string, class_id long, words array<string>"))
    got = {(r["a"], r["b"]) for r in rec.similar_classes(classes).collect()}
    assert got == want and len(want) > 150
    assert len(met) == 1 and met[0].count() < 1.5 * len(want)


def test_sets_that_share_rare_words_dont_meet_unless_they_are_alike(spark):
    """Of sets over few words nearly all share rare ones; what meets by parts stays near the number of alike ones. Small sets of every size in two scopes."""
    rng = random.Random(11)
    sets = [("a", set(rng.sample(range(600), rng.randint(40, 80)))) for _ in range(800)]
    for size in range(1, 30):
        for _ in range(8):
            words = set(rng.sample(range(600), size))
            for k in range(rng.choice([0, 1, 1, 2, 3]) + 1):
                sets.append((rng.choice("ab"), words - set(rng.sample(sorted(words), min(k, size - 1))) | ({700 + rng.randrange(100)} if k % 2 else set())))
    sets = sorted({(scope, tuple(sorted(f"w{x}" for x in words))) for scope, words in sets})
    want = {(i, j) for i, (s, a) in enumerate(sets) for j, (t, b) in enumerate(sets) if i < j and s == t and len(set(a) & set(b)) / len(set(a) | set(b)) >= rec.NEAR}
    classes = rec.tabled(spark.createDataFrame([(s, i, list(w)) for i, (s, w) in enumerate(sets)], "scope string, class_id long, words array<string>"))
    got = {(r["a"], r["b"]) for r in rec.similar_classes(classes).collect()}
    assert got == want and len(want) > 100
    met = rec._parts(classes.where("size(words) >= 40"), rec.NEAR).groupBy("scope", "key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert met < 800 * 799 / 2 * 0.02


def test_groups_are_compared_by_tiles(spark, monkeypatch):
    """A set moves for its tiles and not for its pairs; all pairs of a group are told, with words whose first hashes clash, too."""
    monkeypatch.setattr(likeness, "TILE", 5)
    hashed = likeness.F.xxhash64
    monkeypatch.setattr(likeness.F, "xxhash64", lambda *c: hashed(*c) % 40 if str(c[-1]) == "Column<'0'>" else hashed(*c))
    sets = [[f"w{x}" for x in range(60) if x != n] for n in range(40)] + [["alone"], ["w1", "w2"]]
    classes = spark.createDataFrame([("s", i, w) for i, w in enumerate(sets)], "scope string, class_id long, words array<string>")
    every = [("s", a, b) for a in range(42) for b in range(a + 1, 42)]
    got = likeness.compared(spark.createDataFrame(every, "scope string, a long, b long"), classes, 0.9).collect()
    assert sorted((r["a"], r["b"], r["similarity"]) for r in got) == [(a, b, 58 / 60) for _, a, b in every if b < 40]
