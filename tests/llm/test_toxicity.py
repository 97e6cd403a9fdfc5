"""What a probability means must not depend on how far the labelled sample was thinned."""

import numpy as np

from feedloom.llm import toxicity


def test_probabilities_hold_when_the_sample_is_thinned(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for n in range(6_000):
        toxic = n % 12 == 0
        words = [f"w{rng.integers(400)}" for _ in range(12)]
        words += ["vile"] if toxic and rng.random() < 0.5 else []
        words += ["dubious"] if rng.random() < (0.4 if toxic else 0.1) else []
        rows.append((n, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    asked = spark.createDataFrame([(1, "some dubious words"), (2, "some words"), (3, "vile words")], "doc_id long, text string")

    def found():
        return np.array([r["p_toxic"] for r in toxicity.graded(asked, toxicity.fit(docs, labels)).orderBy("doc_id").collect()])

    whole = found()
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 1_000)
    thinned = found()
    assert np.abs(whole - thinned).max() < 0.06, (whole, thinned)
    # of the texts with the ambiguous word and without the other, 0.2 x 500 are toxic and 0.1 x 5,500 clean
    assert abs(whole[0] - 100 / 650) < 0.06 and whole[2] > 0.9 and thinned[2] > 0.9
