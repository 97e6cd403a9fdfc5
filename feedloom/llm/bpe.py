"""Byte-level BPE encoding and decoding with forced boundaries."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.shared import mapped, slices

# Fixed value: how byte-level BPE vocabularies of this family split a text into pre-tokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts below U+0250, with the classes spelled out, for the faster matcher.
SPACE, LETTER, NUMBER = r"\t-\r \x85\xa0", r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼½¾"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_PRETOKENS, _LATIN_PRETOKENS, _BEYOND_LATIN = regex.compile(PRETOKEN).findall, re.compile(LATIN).findall, re.compile("[^\x00-\u024f]").search
#: Most distinct pre-tokens that a Python worker remembers, of so many characters at most; the memory starts afresh beyond it.
REMEMBERED, SHORT_WORD = 500_000, 64
#: Bytes up to which a piece is merged by plain scans.
SHORT = 100
NEVER = 1 << 60


def pretokens(text: str) -> list[str]:
    """The text cut into pre-tokens; they add up to the text."""
    return _PRETOKENS(text) if _BEYOND_LATIN(text) else _LATIN_PRETOKENS(text)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes are themselves, the others take the letters from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


class Codec:
    """Encodes and decodes by a tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_of = {self.bytes_of[i]: i for t, i in vocab.items() if t not in self.special}
        self.decimal = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.first = [self.id_of[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 32 | vocab[b]: n for n, (a, b) in enumerate(pairs)}
        self.result = [vocab[a + b] for a, b in pairs]
        #: byte pairs that stand side by side inside some token; a cut between any others is certain
        self.joined = {p for t in self.id_of for p in zip(t, t[1:])}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut wherever its two neighbouring bytes never stand together inside a token:
        no merge can span such a place, so the pieces encode independently."""
        joined = self.joined
        cuts = [i for i, p in enumerate(zip(word, word[1:]), 1) if p not in joined]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def merged(self, piece: bytes) -> list[int]:
        """The piece's ids: the merge of least rank first, the leftmost of equal rank."""
        ids = [self.first[b] for b in piece]
        if len(ids) > SHORT:
            return self._merged_by_heap(ids)
        rank, result = self.rank.get, self.result
        ranks = [rank(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i] = result[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], NEVER)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for long pieces, in n log n: a heap of (rank, place) over a linked list."""
        rank, result = self.rank, self.result
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or rank.get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], right[i] = result[r], -1, right[j]
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (n := rank.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (n, a))
            if right[i] >= 0:
                left[right[i]] = i
        return [x for x in ids if x >= 0]

    def word_ids(self, word: str) -> tuple[int, ...]:
        return tuple(i for piece in self.fragments(word.encode()) for i in self.merged(piece))

    def encode(self, text: str | None) -> list[int]:
        """The ids of the whole text; a special token's own string is that token. Null is empty."""
        ids: list[int] = []
        for part in self.specials.split(text or "") if self.specials else [text or ""]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in pretokens(part):
                found = self.known.get(word)
                if found is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    found = self.word_ids(word)
                    if len(word) <= SHORT_WORD:
                        self.known[word] = found
                ids += found
        return ids

    def decimals(self, ids: list[int]) -> str:
        """The ids as decimals, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids: array<int>) of every whole text; null and empty texts have no ids, repeated rows stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = codec(path).encode
        for part in slices(batches, "text"):
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [encode(t) for t in part["text"]]})

    return mapped(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_chars, decoded_sha256): each whole text encoded, its ids decoded again in the same pass.

    n_chars: code points of the decoded text. Null texts count as empty, repeated rows stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for part in slices(batches, "text"):
            ids = [own.encode(t) for t in part["text"]]
            texts = [own.decode(i) for i in ids]
            hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(i) for i in ids], "ids": ids, "n_chars": [len(t) for t in texts], "decoded_sha256": hashes})

    return mapped(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, n_tokens long, ids array<int>, n_chars long, decoded_sha256 string")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``tokens`` (doc_id, ids). Null ids count as none, repeated rows stay, an empty table gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = codec(path).decode
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": [decode(i) for i in part["ids"]]})

    return tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, then decoded again, in one pass.

    Null texts count as empty, repeated rows stay, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for part in slices(batches, "text"):
            rows = []
            for text in part["text"]:
                ids = own.encode(text)
                rows.append((len(ids), hashlib.sha256(own.decimals(ids).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", part["doc_id"])
            yield out

    return mapped(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
