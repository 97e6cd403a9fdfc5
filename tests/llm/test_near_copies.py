"""The pipeline's near-duplicate stage against all pairs by exact similarity."""

import re

import brute
import numpy as np
import pytest

import corpus_pipeline as pipeline
from feedloom.llm import near_copies


def shingles(text):
    words = brute.SPACES.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


def left(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}


def roots(rows):
    sets = {i: shingles(t) for i, t in rows}
    order = sorted(sets)
    like = [(a, b) for n, a in enumerate(order) for b in order[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = brute.components(order, like)
    return {i for i in order if root[i] == i}


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, "a b c"), (3, "A b  c"), (4, "a b d")]
    for n in range(60):
        words = [f"w{rng.integers(5000)}" for _ in range(200)]
        # five edited words leave about 0.78 to 0.82 of the shingles, one or two nearly all, twelve about 0.55
        rows += [(100 * n + 100 + k, edited(rng, words, k)) for k in (0, 1, 2, 5, 12)]
    assert left(spark, rows) == roots(rows)


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(6)
    words = [f"w{rng.integers(5000)}" for _ in range(300)]
    rows = [(n, edited(rng, words, 2)) for n in range(300)]
    assert left(spark, rows) == roots(rows) == {0}


def test_pairs_within_a_large_group_of_less_like_texts_are_found(spark):
    rng = np.random.default_rng(7)
    common = [f"w{rng.integers(5000)}" for _ in range(170)]
    rows = []
    for n in range(150):
        # 0.74 like the others of the group, 0.85 like the second of the pair
        own = [f"a{rng.integers(1 << 40)}" for _ in range(14)]
        rows += [(2 * n + k, " ".join(common + own + [f"b{rng.integers(1 << 40)}" for _ in range(16)])) for k in (0, 1)]
    assert left(spark, rows) == roots(rows) == set(range(0, 300, 2))


@pytest.mark.parametrize("rows", [2_000])
def test_template_texts(spark, rows):
    """Pairs of edited copies of texts that are made of the same blocks: every pair that is 0.8 alike is found, and nothing else."""
    rng = np.random.default_rng(12)
    blocks = [[f"w{rng.integers(1 << 30)}" for _ in range(10)] for _ in range(100)]
    texts = []
    for n in range(rows // 2):
        words = [w for k, block in enumerate(blocks) if k % 2 == 0 or rng.random() >= 0.5 for w in block]
        texts += [(2 * n + k, edited(rng, words, 13 if k else 0)) for k in (0, 1)]
    sets = [shingles(t) for _, t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    # texts of different pairs aren't alike
    assert max(like(*rng.choice(rows, 2, replace=False) // 2 * 2) for _ in range(500)) < 0.78
    want = {n for n in range(rows) if n % 2 == 0 or like(n, n - 1) < 0.8}
    assert len(want) < 0.55 * rows and left(spark, texts) == want


def test_shared_counts():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 90, n)) for n in (1, 5, 40, 70, 90)]
    got = near_copies._shared(sets[:2] + sets[3:], sets)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets] for x in sets[:2] + sets[3:]]
    assert near_copies._shared([np.array([1])], [np.array([2])]).tolist() == [[0]]


def test_tiles_of_all_sizes_meet(spark, monkeypatch):
    """Sets of many sizes in tiles of three: the links join exactly what all pairs join."""
    monkeypatch.setattr(near_copies, "TILE", 3)
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        whole = rng.integers(1 << 62, size=rng.integers(1, 80))
        sets += [np.unique(whole[rng.random(len(whole)) < 0.95]) for _ in range(3)]
    sets = [x for x in sets if len(x)]
    rows = [(n, n % 2, [int(y) for y in x]) for n, x in enumerate(sets)]
    got = near_copies.complete_links(spark.createDataFrame(rows, "fp long, part long, shingles array<long>")).collect()
    like = [(a, b) for a in range(len(sets)) for b in range(a) if a % 2 == b % 2 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    ids = range(len(sets))
    assert len(like) > 20 and brute.components(ids, [(r["a"], r["b"]) for r in got]) == brute.components(ids, like)


@pytest.mark.parametrize("bits", [16, 21])
@pytest.mark.parametrize("common,one,two", [(4, 0, 1), (8, 1, 1), (8, 0, 2), (12, 0, 2), (12, 0, 3), (24, 3, 3), (240, 30, 30)])
def test_simhash_alone_proposes_near_copies(bits, common, one, two):
    """Sets of similarity 0.8, or just above it, share a bucket of SimHash fingerprints and pass its filter."""
    rng = np.random.default_rng(13)
    tables = near_copies.TABLES[bits - near_copies.FEWEST_BITS]
    missed = 0
    for _ in range(500):
        x = rng.integers(0, 1 << 64, common + one + two, dtype=np.uint64)
        found = [np.unique(x[: common + one]), np.unique(np.append(x[:common], x[common + one :]))]
        (sim, keys), (sim_two, keys_two) = (near_copies.probes(f, bits, tables) for f in found)
        every = [np.stack([k[:, 0], *(k[:, 0] ^ k[:, i] for i in (1, 2, 3))], 1) for k in (keys, keys_two)]
        probed = min(map(len, found)) > near_copies.BARE and (every[0][:, :, None] == every[1][:, None, :]).any() and (sim ^ sim_two).bit_count() <= near_copies.NEAR
        missed += not (probed or len(np.intersect1d(*map(near_copies.partial, found))))
    assert missed <= (0 if common + one + two <= near_copies.SHORT else 3)


def test_short_texts_and_what_chance_brings_into_their_buckets(spark):
    """Texts of 8 to 18 words that lose or get a word at an end, and a group of copies with others in its buckets."""
    rng = np.random.default_rng(14)
    rows = []
    for n in range(150):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(8 + n % 11)]
        rows += [(10 * n + k, " ".join(words[k:] if k < 2 else words[:-1] if k == 2 else [*words, "more"])) for k in range(4)]
    common = [f"c{rng.integers(1 << 40)}" for _ in range(120)]
    rows += [(2_000 + n, edited(rng, common, 1)) for n in range(60)] + [(3_000 + n, edited(rng, common, 8)) for n in range(6)]
    assert left(spark, rows) == roots(rows)


def test_buckets_over_several_batches(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BATCH", 7)
    rows = [(key, 100 * key + n, 0) for key, size in ((1, 2), (2, 40), (3, 1), (4, 16), (5, 17), (6, 3)) for n in range(size)]
    got = near_copies.met(spark.createDataFrame(rows, "key long, fp long, sim long")).collect()
    assert sorted(r["a"] for r in got if r["b"] is None) == sorted(fp for key, fp, _ in rows if key in (2, 5))
    pairs = {(r["a"], r["b"]) for r in got if r["b"] is not None}
    assert all(a < b and a // 100 == b // 100 == key for a, b, key in ((r["a"], r["b"], r["key"]) for r in got if r["b"] is not None))
    sizes = {key: sum(a // 100 == key for a, _ in pairs) for key in range(1, 7)}
    assert sizes == {1: 1, 2: 39 + 38, 3: 0, 4: 120, 5: 16 + 15, 6: 3}
