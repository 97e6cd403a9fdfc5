"""Text canonicalisation and scalar rules, as columns. Patterns hold in Java and in RE2 alike."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: What counts as white space at a text's ends.
SPACE = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: Below U+0300 every text is in NFC already.
MAY_COMPOSE = r"[^\x00-\x{2ff}]"
URL_ONLY = r"(?i)^[\t-\r ]*https?://[^\t-\r ]+[\t-\r ]*$"
DEVANAGARI, LATIN_WORD = r"[\x{900}-\x{97f}]", r"[A-Za-z]{2,}"
LEAST_DETECTED, LEAST_MEANINGFUL = 12, 15

# Word lists of the rules, in the order of their source.
SPAM = ("click here to win", "free gift card", "whatsapp me at", "dm me for a discount code")
DEMOGRAPHIC = (
    "young professional", "elderly", "housewife", "middle-aged", "male user", "female user", "high-income", "low-income", "student budget", "working mother",
    "working father", "teenage", "in his 20s", "in her 20s", "in his 30s", "in her 30s", "in his 40s", "in her 40s", "senior citizen", "bachelor lifestyle",
)
CAUSAL = (
    "causes", "caused by", "causing", "leads to", "leading to", "led to", "results in", "resulting in", "resulted in", "is the reason", "is why users",
    "drives users to", "makes users", "forces users to", "as a direct result of",
)
SUPPORTED = ("en", "hi")

#: Function words by language, for texts that come without a language.
FUNCTION_WORDS = {
    "en": "the and of to is in that it was for with this not are have",
    "de": "der die und das ist nicht ein mit den von zu auf für sich dem",
    "fr": "le la les et des est une dans que pour pas sur au avec qui",
    "es": "el los las una y en que es por con para del se no más",
}


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def normalized(text: Column) -> Column:
    """NFC, no control characters, runs of blanks to one, of three or more line ends to two, stripped; null is empty.

    Only texts that may change under NFC travel to Python.
    """
    text = F.coalesce(text, F.lit(""))
    text = F.coalesce(_nfc(F.when(text.rlike(MAY_COMPOSE), text)), text)
    for pattern, by in ((CONTROL, ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return stripped(text)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def tokens(text: Column) -> Column:
    """The distinct runs of a-z and 0-9 of the lowered text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two token sets: 1 for two empty ones, 0 for one empty one."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)))


def guessed_language(text: Column) -> Column:
    """The language most of whose function words a text holds; null where none does. Devanagari is hi."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    votes = [F.struct(F.size(F.filter(words, lambda w, known=known: w.isin(*known.split()))).alias("n"), F.lit(code).alias("code")) for code, known in FUNCTION_WORDS.items()]
    best = F.array_max(F.array(*votes))
    return F.when(text.rlike(DEVANAGARI), F.lit("hi")).when(best["n"] > 0, best["code"])


def language(text: Column, code: Column) -> Column:
    """struct(code, mixed, supported) of a normalised text, from a detector's code; texts under 12 characters have none."""
    long = F.length(text) >= LEAST_DETECTED
    mixed = long & text.rlike(DEVANAGARI) & text.rlike(LATIN_WORD)
    code = F.when(long, code)
    return F.struct(code.alias("code"), F.coalesce(mixed, F.lit(False)).alias("mixed"), F.coalesce(mixed | code.isin(*SUPPORTED), F.lit(False)).alias("supported"))


def holds_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """True where the lowered text holds one of the phrases; false for null."""
    # lowered once: a one-element array hands it to all the tests
    found = F.transform(F.array(F.lower(text)), lambda t: reduce(or_, (t.contains(p) for p in phrases)))
    return F.coalesce(found[0], F.lit(False))


def demographic(text: Column) -> Column:
    return holds_any(text, DEMOGRAPHIC)


def causal(text: Column) -> Column:
    return holds_any(text, CAUSAL)


def relevance(text: Column) -> Column:
    """insufficient_content, spam_or_promotion or unreviewed, of a normalised text."""
    return F.when((text == "") | text.rlike(URL_ONLY), "insufficient_content").when(holds_any(text, SPAM), "spam_or_promotion").otherwise("unreviewed")


def quality(original: Column, text: Column, lang: Column) -> Column:
    """malformed, unsupported_language, low_information or usable, the first that holds, of a normalised text; an unknown language is not an unsupported one."""
    return (
        F.when((text == "") & (stripped(F.coalesce(original, F.lit(""))) != ""), "malformed")
        .when(lang["code"].isNotNull() & ~lang["mixed"] & ~lang["supported"], "unsupported_language")
        .when(F.length(text) < LEAST_MEANINGFUL, "low_information")
        .otherwise("usable")
    )


def rating(value: Column, scale: Column) -> Column:
    return F.when(scale != 0, value / scale)


def with_media_text(text: Column, extracted: Column) -> Column:
    """The text with what was extracted from its media; either one empty gives the other."""
    text, extracted = F.coalesce(text, F.lit("")), F.coalesce(extracted, F.lit(""))
    return F.when(extracted == "", text).when(text == "", extracted).otherwise(F.concat(text, F.lit("\n\n[Extracted from media]\n"), extracted))


def located(text: Column, excerpt: Column) -> Column:
    """(start, end) of the excerpt's first place; null where it is empty or absent."""
    at = F.instr(text, excerpt)
    return F.when((excerpt != "") & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(excerpt)).alias("end")))


def excerpt(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def delimited(text: Column, tag: str = "untrusted") -> Column:
    """The text between boundary tags, its own copies of them taken out."""
    inner = F.replace(F.replace(text, F.lit(f"<{tag}>"), F.lit("")), F.lit(f"</{tag}>"), F.lit(""))
    return F.concat(F.lit(f"<{tag}>\n"), inner, F.lit(f"\n</{tag}>"))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def confidence_bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.55, "medium").when(score.isNotNull(), "low")


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def non_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


def author_hash(name: Column) -> Column:
    return F.when(name != "", F.sha2(name, 256))
