"""SimHash near-duplicates, found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.shared import checkpointed, components, slices

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included; bit 1 where over half of the shingle hashes have it.

    A-Z are lowered, words are split at the ASCII white space; fewer words than a shingle make
    one shingle; no word gives zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)
    return folded(hashes)


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 where over half of them have it."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long) for every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(x, shingle) for x in part["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": fps})

    # bytes, so that the Python side neither decodes nor copies the text
    return docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInPandas(run, "doc_id long, fp long")


def segments(radius: int, pieces: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: any two fingerprints within ``radius`` bits
    are, in one segment at least, within that segment's radius (Norouzi et al. 2012)."""
    base, extra = divmod(radius, pieces)
    cuts = [round(i * BITS / pieces) for i in range(pieces + 1)]
    found = [(cuts[i], cuts[i + 1] - cuts[i], base if i <= extra else base - 1) for i in range(pieces)]
    return [s for s in found if s[2] >= 0]


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def links(fps: DataFrame, radius: int = 2, pieces: int = 2) -> DataFrame:
    """(a, b) for each two of the distinct fingerprints in ``fps`` (fp, rep) within ``radius`` bits, by their reps, a < b.

    Each fingerprint is stored once per segment and asks for the Hamming ball around each of
    its segments; what an equi-join on (segment, key) fetches is verified over all bits inside
    the join. Copies are one fingerprint here, so groups of copies emit nothing.
    """
    tables, probes = [], []
    for n, (shift, width, near) in enumerate(segments(radius, pieces)):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = ball(width, near)
        tables.append(F.struct(F.lit(n).alias("seg"), key.alias("key")))
        probes += [F.struct(F.lit(n).alias("seg"), key.bitwiseXOR(F.lit(m)).alias("key")) for m in masks]
    stored = fps.select(F.col("fp").alias("fp_b"), F.col("rep").alias("b"), F.explode(F.array(*tables)).alias("at")).select("fp_b", "b", "at.*")
    asked = fps.select("fp", F.col("rep").alias("a"), F.explode(F.array(*probes)).alias("at")).select("fp", "a", "at.*")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= radius)
    return asked.join(stored, (asked["seg"] == stored["seg"]) & (asked["key"] == stored["key"]) & near).select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, pieces: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the least doc_id that links of at most ``radius`` bits reach.

    Null and empty texts have fingerprint zero and link like any other; rows with a null doc_id
    are left out of the linking and keep a null component; repeated rows stay. An empty table
    gives no rows. Other columns of ``docs`` are ignored.
    """
    fps = checkpointed(fingerprints(docs, shingle))
    reps = checkpointed(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(reps, radius, pieces))
    classes = checkpointed(reps.join(found, reps["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
