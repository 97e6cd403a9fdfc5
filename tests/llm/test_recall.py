"""Recall of disguised personal data and of random secrets, planted between ordinary words, by disguise and by encoding and length."""

import random
import string

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom.llm import pii, secrets

WORDS = "please send the report before noon and tell our team about it when you can since nobody else has seen this yet".split()
NAMES = "jane bob maria piotr lena chris otto emma".split()
HOSTS = "example mailbox company server kitchen garden".split()
TLDS = "org com net de fr es".split()
DIGIT_NAMES = [next(w for w, d in pii.SPELLED.items() if d == str(n)) for n in range(10)]
TWINS = {latin: twin for twin, latin in zip(reversed(pii.LOOKALIKES), reversed(pii.LATIN))}


def address(rng):
    return f"{rng.choice(NAMES)}.{rng.choice(NAMES)}{rng.randrange(100)}", f"{rng.choice(HOSTS)}.{rng.choice(TLDS)}"


def card(rng):
    digits = "4" + "".join(rng.choices(string.digits, k=14))
    return next(digits + d for d in string.digits if pii.luhn(digits + d))


def ip(rng):
    return ".".join(str(rng.randrange(256)) for _ in range(4))


def phone(rng):
    return "+" + rng.choice("123456789") + "".join(rng.choices(string.digits, k=10))


def twins(rng, text):
    spots = set(rng.sample([n for n, c in enumerate(text) if c in TWINS], 2))
    return "".join(TWINS[c] if n in spots else c for n, c in enumerate(text))


def wide(text):
    return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in text)


def hidden(rng, text):
    at = rng.randrange(1, len(text) - 1)
    return text[:at] + "​" + text[at:]


def spelled(text):
    return " ".join(DIGIT_NAMES[int(c)] for c in text)


DISGUISES = {
    ("email", "look-alikes"): lambda r: twins(r, "@".join(address(r))),
    ("email", "hidden sign"): lambda r: hidden(r, "@".join(address(r))),
    ("email", "brackets"): lambda r: " (at) ".join(address(r)).replace(".", r.choice([" (dot) ", "[dot]", "."])),
    ("email", "bare words"): lambda r: " at ".join(address(r)).replace(".", " dot "),
    ("email", "spaced sign"): lambda r: " @ ".join(address(r)),
    ("ip", "full width"): lambda r: wide(ip(r)),
    ("ip", "brackets"): lambda r: ip(r).replace(".", "[.]"),
    ("card", "full width"): lambda r: wide(card(r)),
    ("card", "spelled"): lambda r: spelled(card(r)),
    ("card", "hidden sign"): lambda r: hidden(r, card(r)),
    ("phone", "full width"): lambda r: wide(phone(r)),
    ("phone", "spelled"): lambda r: "+" + spelled(phone(r)[1:]),
    ("phone", "hidden sign"): lambda r: hidden(r, phone(r)),
}


def between(rng, planted):
    before, after = (" ".join(rng.choices(WORDS, k=8)) for _ in range(2))
    return f"{before} {planted}, {after}", len(before) + 1


@pytest.mark.parametrize("kind, how", DISGUISES)
def test_disguised_identifiers_are_found_where_they_stand(kind, how):
    rng, whole = random.Random(f"{kind} {how}"), 0
    for _ in range(300):
        planted = DISGUISES[kind, how](rng)
        text, at = between(rng, planted)
        whole += (kind, at, at + len(planted)) in pii.spans(text)[1]
    print(kind, how, whole / 300)
    assert whole >= 0.9 * 300


def test_ordinary_texts_gain_no_spans():
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"]
    rng = random.Random(1)
    made = [" ".join(rng.choices([*WORDS, "at", "at", "point", "one", "two", "7", "2024", "(7)", "3.5"], k=40)) for _ in range(2000)]
    gained = sum(len(pii.spans(t)[1]) - sum(map(len, pii.spans(t)[0].values())) for t in texts)
    assert gained == 0 and sum(bool(pii.spans(t)[1]) for t in made) <= 0.01 * len(made)


ENCODINGS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": string.ascii_letters + string.digits + "+/"}
NOUNS = "account order customer index value session report weekly table column total average number window update summary region supplier history primary".split()


def ordinary(rng):
    """A long name with digits: joined by a sign or capitals, with a number, a version or a date."""
    words = rng.choices(NOUNS, k=3)
    tail = rng.choice([f"{rng.randrange(10**6):06}", f"v{rng.randrange(9)}", f"2024-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"])
    return rng.choice(["_".join([*words, tail]), "/".join([*words, tail]), "-".join([*words, tail]), "".join(w.title() for w in words) + tail.replace("-", "")])


def test_random_tokens_are_found_by_encoding_and_length(spark):
    rng, rows = random.Random(3), []
    for name, alphabet in ENCODINGS.items():
        for n in (20, 24, 32, 40, 64):
            rows += [(f"{name} {n}", "see " + "".join(rng.choices(alphabet, k=n)) + " there") for _ in range(60)]
    rows += [("ordinary", f"see {t} there") for t in (ordinary(rng) for _ in range(3000)) if len(t) >= 20]
    found = secrets.found(spark.createDataFrame(rows, "what string, text string"))
    share = {r["what"]: r["share"] for r in found.groupBy("what").agg(F.avg(F.exists("spans", lambda s: s["k"] == 3).cast("int")).alias("share")).collect()}
    print(share)
    # of hexadecimal tokens, those without a letter or a digit aren't tested
    assert all(v >= 0.9 for k, v in share.items() if k != "ordinary") and share["ordinary"] <= 0.25


def test_a_span_that_holds_a_base_span_is_added_and_masked_once():
    text = "ask jаne.bob@example.org or joe@example.org"
    plain, found = pii.spans(text)
    assert [text[a:b] for a, b in plain["email"]] == ["ne.bob@example.org", "joe@example.org"]
    assert [text[a:b] for _, a, b in found] == ["jаne.bob@example.org", "ne.bob@example.org", "joe@example.org"]
    assert pii.redacted(text, found) == "ask [EMAIL] or [EMAIL]"
