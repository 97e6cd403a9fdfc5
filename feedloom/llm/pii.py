"""Personal data in texts, also where it is disguised, by offset-preserving deobfuscation."""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.shared import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# An e-mail's only anchor is its @: what stands before it is the whole run of these characters.
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does.
IP = re.compile(r"[0-9](?<![0-9].)[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SEPARATORS = str.maketrans("", "", " ().+-")
DIGIT = re.compile("[0-9]")

# Letters of other alphabets that look like Latin ones, in the order of the Latin letters below them.
LOOKALIKES = "аАᴀВвсСԁеЕһНіІјЈкКӏӀмМոоОՕрРԛѕЅтТυѵѡхХуУαΑΒεΕΗιΙκΚΜΝνοΟρΡτΤχΧΥΖ"
LATIN = "aAaBbcCdeEhHiIjJkKlImMnoOOpPqsStTuvwxXyYaABeEHiIkKMNvoOpPtTxXYZ"
LOOKALIKE = dict(zip(LOOKALIKES, LATIN)) | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # and the full-width forms
LOOKALIKE |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966) for d in range(10)}  # digits of three other scripts
LOOKALIKE |= {"　": " ", " ": " ", "‐": "-", "‑": "-", "‒": "-", "–": "-", "․": ".", "。": "."}
INVISIBLE = "​‌‍⁠﻿­"
STRANGE = re.compile("[" + "".join(map(re.escape, LOOKALIKE)) + INVISIBLE + "]")

# How digits are spelled in the four languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Four or more spelled or written digits in a row, one of them spelled at least.
DIGIT_WORDS = re.compile(rf"(?<!\w)(?:(?:{_WORD}|[0-9])(?:[ ,.-]{{1,2}}|(?![^\W_]))){{3,}}(?:{_WORD}|[0-9])(?!\w)", re.I)
#: A run of digits without one of these is none; "un" alone is an article.
HINTS = frozenset(SPELLED) - {"un"}
BREAKS = str.maketrans(",.-", "   ")
LONG_WORD = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.I)
#: name (at) host (dot) tld, with any brackets, or with bare words where both are words.
BRACKETED = re.compile(r" ?(?:[(\[{<] ?(?:at|@|arroba|chez) ?[)\]}>]) ?", re.I)
BRACKETED_DOT = re.compile(r" ?(?:[(\[{<] ?(?:dot|\.|punto|punkt|point) ?[)\]}>]) ?", re.I)
BARE_AT = re.compile(r" at ", re.I)
BARE_HOST = re.compile(r"(?!(?:the|a|an|this|that|our|my|your) )[A-Za-z0-9-]+(?:(?: [Dd][Oo][Tt] |\.)[A-Za-z0-9-]+)*(?: [Dd][Oo][Tt] )[A-Za-z]{2,24}(?![A-Za-z0-9])")
BARE_DOT = re.compile(r" dot ", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9]) @ ?(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@ (?=[A-Za-z0-9-]+\.[A-Za-z])")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches, in time linear in the text."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := AT_DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].translate(SEPARATORS)) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(m[0].translate(SEPARATORS)) <= 15:
                yield m.span()


def base(text: str) -> dict[str, list[Span]]:
    """The spans of each kind that stand in the text as it is."""
    digits = DIGIT.search(text) is not None
    return {"email": list(emails(text)) if "@" in text else [], "ip": list(ips(text)) if digits else [], "card": list(cards(text)) if digits else [], "phone": list(phones(text)) if digits else []}


class Rewriter:
    """A text under rewriting, each step a transducer pass, that can map its spans back to the source."""

    def __init__(self, text: str):
        self.text = text
        self.steps: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the given spans (sorted, disjoint) of the present text."""
        if not edits:
            return
        out, new, old, new_end, old_end, at, length = [], [], [], [], [], 0, 0
        for a, b, s in edits:
            out += [self.text[at:a], s]
            length += a - at
            new.append(length)
            old.append(a)
            length += len(s)
            new_end.append(length)
            old_end.append(b)
            at = b
        out.append(self.text[at:])
        self.text = "".join(out)
        self.steps.append((new, old, new_end, old_end))

    def source(self, start: int, end: int) -> Span:
        """Where the span of the present text stands in the source; a replacement counts whole."""
        for new, old, new_end, old_end in reversed(self.steps):
            i = bisect_right(new, start) - 1
            j = bisect_right(new, end - 1) - 1
            start = start if i < 0 else old[i] if start < new_end[i] else old_end[i] + start - new_end[i]
            end = end if j < 0 else old_end[j] if end <= new_end[j] else old_end[j] + end - new_end[j]
        return start, end


def _letters(text: str) -> list[tuple[int, int, str]]:
    """Homoglyphs to Latin letters, digits and signs; invisible characters to nothing."""
    if text.isascii():
        return []
    return [(m.start(), m.end(), LOOKALIKE.get(m[0], "")) for m in STRANGE.finditer(text)]


def _digits(text: str) -> list[tuple[int, int, str]]:
    """Each run of spelled digits to written ones."""
    edits = []
    if HINTS.isdisjoint(text.translate(BREAKS).lower().split()):
        return edits
    for m in DIGIT_WORDS.finditer(text):
        if LONG_WORD.search(m[0]):
            words = re.findall(rf"{_WORD}|[0-9]", m[0], re.I)
            edits.append((m.start(), m.end(), "".join(SPELLED.get(w.lower(), w) for w in words)))
    return edits


def _bare_name(text: str, end: int, free: int) -> int:
    """Where the name that ends at ``end`` begins, not before ``free``; names may be joined by the word dot."""
    start = end
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    while start - 5 > free and text[start - 5 : start].lower() == " dot " and text[start - 6] in LOCAL:
        start -= 5
        while start > free and text[start - 1] in LOCAL:
            start -= 1
    return start


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Disguised @ and dots to the signs."""
    edits = [(*m.span(), "@") for m in SPACED_AT.finditer(text)] if "@" in text else []
    if any(b in text for b in "([{<"):
        edits += [(*m.span(), "@") for m in BRACKETED.finditer(text)] + [(*m.span(), ".") for m in BRACKETED_DOT.finditer(text)]
    free = 0
    for at in BARE_AT.finditer(text) if BARE_DOT.search(text) else ():
        start = _bare_name(text, at.start(), free)
        if start < at.start() and (host := BARE_HOST.match(text, at.end())):
            edits.append((*at.span(), "@"))
            edits += [(*d.span(), ".") for a, b in ((start, at.start()), host.span()) for d in BARE_DOT.finditer(text, a, b)]
            free = host.end()
    edits.sort()
    return [e for n, e in enumerate(edits) if n == 0 or e[0] >= edits[n - 1][1]]


def spans(text: str | None) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """(base spans by kind, all spans as (kind, start, end) by kind, then start).

    The disguised ones are found in the rewritten text by the same patterns and mapped back. One that
    meets base spans of its kind is added where it holds them whole and reaches beyond them, as of an
    address that a strange letter cuts in two.
    """
    text = text or ""
    plain = base(text)
    again = Rewriter(text)
    for step in (_letters, _digits, _addresses):
        again.apply(step(again.text))
    found = [(k, *s) for k in KINDS for s in plain[k]]
    if again.steps:
        for kind, more in base(again.text).items():
            taken = plain[kind]
            for a, b in (again.source(*s) for s in more):
                met = taken[bisect_right(taken, a, key=lambda s: s[1]) : bisect_left(taken, b, key=lambda s: s[0])]
                if (a, b) not in met and all(a <= start and end <= b for start, end in met):
                    found.append((kind, a, b))
        found.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return plain, found


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row; offsets are code points, ends exclusive.

    Null texts count as empty (no spans), repeated rows stay, an empty table gives no rows,
    other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text"):
            rows = []
            for text in part["text"]:
                plain, found = spans(text)
                own = joined([(k, *s) for k in KINDS for s in plain[k]])
                rows.append((*(len(plain[k]) for k in KINDS), hashlib.sha256(own.encode()).hexdigest(), joined(found)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", part["doc_id"])
            yield out

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap make one gap, of the earliest, longest one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
