"""Token counts under a unigram model, by dynamic programming shared along a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.bpe import pretokens
from feedloom.llm.shared import slices

#: Most distinct pre-tokens whose counts a Python worker remembers, of so many characters at most; the memory starts afresh beyond it.
REMEMBERED, SHORT_WORD = 500_000, 64


class Unigram:
    """Log-probabilities of a ranked vocabulary's tokens, by Zipf's law: p is as 1 / (rank + 1)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.score = {t: -math.log(r + 1) - norm for t, r in ranks.items()}
        self.longest = max(map(len, self.score))
        self.known: dict[str, int] = {}
        self.long: list[str] = []

    def counts(self, words: Iterable[bytes]) -> Iterator[int]:
        """For each of the words, in their sorted order, the tokens of its most probable segmentation; of equally probable ones the fewest.

        Words in order walk their trie depth first. A node holds its prefix's forward score
        (that of the prefix's best segmentation) and count; going on to the next word, only the
        nodes below the shared prefix are worked out.
        """
        scores, numbers, before = [0.0], [0], b""
        get, longest = self.score.get, self.longest
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del scores[shared + 1 :], numbers[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, number = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    if (p := get(word[start:end])) is not None:
                        s = scores[start] + p
                        if s > best or (s == best and numbers[start] + 1 < number):
                            best, number = s, numbers[start] + 1
                scores.append(best)
                numbers.append(number)
            before = word
            yield numbers[len(word)]

    def learn(self, words: set[str]) -> None:
        """Stores the counts of those of the words that are not known yet; long ones of earlier texts are forgotten."""
        for word in self.long:
            self.known.pop(word, None)
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        self.long = [w for w in words if len(w) > SHORT_WORD]
        fresh = sorted((w.encode(), w) for w in words if w not in self.known)
        for (_, word), n in zip(fresh, self.counts(b for b, _ in fresh)):
            self.known[word] = n


@lru_cache(2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_bytes) of each whole text.

    A batch's distinct pre-tokens are counted once, then summed up by text; nothing is shuffled.
    Null and empty texts have 0 tokens, repeated rows stay, an empty table gives no rows, other
    columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unigram(path)
        for part in slices(batches, "text", 4_000_000):
            words = [pretokens(t) for t in part["text"]]
            model.learn(set().union(*words))
            known = model.known
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [sum(map(known.__getitem__, w)) for w in words], "n_pretokens": [len(w) for w in words], "n_bytes": [len(t.encode()) for t in part["text"]]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, n_pretokens long, n_bytes long")
