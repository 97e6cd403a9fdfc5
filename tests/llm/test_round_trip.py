"""The pipeline's last stage encodes and decodes."""

import brute

import corpus_pipeline as pipeline


def test_ids_decode_to_the_stages_texts(spark):
    texts = [(1, "plain words, twice plain words"), (2, None), (3, ""), (4, "emoji 😀 ünï 한국어 <|endoftext|> \x00 end"), (None, "x y")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.encode(spark, docs, "").collect()
    assert {(r["doc_id"], r["n_chars"], r["decoded_sha256"]) for r in got} == {(i, len(t or ""), brute.sha(t or "")) for i, t in texts}
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
