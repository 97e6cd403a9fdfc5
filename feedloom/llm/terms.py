"""Terms of texts for the audit and the lexical search."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes that are split at once, about, so that a very long text doesn't become one list of words.
PIECE = 1 << 22


def alphabet(digits: bool) -> bytes:
    """A table for bytes.translate: A-Z are lowered; ASCII letters (and digits) and all bytes of other characters stay, the rest turn into blanks."""
    keep = lambda b: b >= 128 or chr(b).isalpha() or (digits and chr(b).isdigit())
    return bytes(ord(chr(b).lower()) if b < 128 and keep(b) else b if keep(b) else 32 for b in range(256))


def pieces(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in their order, in lists of bounded size; terms are never cut."""
    if len(text) <= PIECE:
        yield text.translate(table).split()
        return
    clean, at = text.translate(table), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end
