"""Secrets in texts: known shapes, and tokens that a battery of randomness tests can't tell from noise. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# As whole runs: a run too short for its kind can't hold a longer match.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What may be an encoded secret: a long run with a digit and a letter in it.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets by encoding, the first that fits is taken; for the last, - and _ count as + and /.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
#: Share of wrongly rejected random tokens among the rejected ones; tokens are judged among those of their encoding and length band.
FALSE_DISCOVERIES = 0.05
#: p-values are counted in so many classes for each factor of ten, down to 1e-12.
CLASSES = 8
# The polynomial for the normal tail (Abramowitz and Stegun 26.2.17).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

Span = "array<struct<s:int,e:int,t:string>>"


def _located(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """df with ``name``: the leftmost non-overlapping matches in text, (s, e, t): start and end in code points, and the match.

    Places follow from the lengths of what stands between the matches.
    """
    df = df.withColumn("_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_between", F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    pairs = F.zip_with(F.slice("_between", 1, F.size("_found")), F.col("_found"), lambda between, t: F.struct(between.alias("between"), t.alias("t")))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["between"])
        end = start + F.length(x["t"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["t"].alias("t")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(Span).alias("out"))
    return df.withColumn(name, F.when(F.size("_found") > 0, F.aggregate(pairs, zero, add, lambda state: state["out"])).otherwise(F.array().cast(Span))).drop("_found", "_between")


def _upper(z: Column) -> Column:
    """P(standard normal > z)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-12))


def _two_sided(tail: Column) -> Column:
    """The p-value of a deviation by the tail beyond its size; none counts as the least."""
    return F.when(tail.isNull(), F.lit(1e-12)).otherwise(F.least(2 * tail, F.lit(1.0)))


def _tested(token: Column) -> Column:
    """(band, p) of one token (s, e, t): its encoding and length band, and the battery's p-value under randomness."""
    bare = F.rtrim(token["t"], F.lit("="))
    encoding = F.when(bare.rlike("^[0-9a-f]+$"), 0).when(bare.rlike("^[0-9A-F]+$"), 1).when(bare.rlike("^[A-Z2-7]+$"), 2).otherwise(3)
    marks = F.array(*map(F.lit, ALPHABETS))
    # one struct after another through one-element transforms, so that each value is worked out once and stands once in the plan that the driver holds
    first = F.array(F.struct(token["s"].alias("s"), token["e"].alias("e"), F.translate(bare, "-_", "+/").alias("t"), encoding.alias("k")))

    def symbols(x: Column) -> Column:
        alphabet = F.element_at(marks, x["k"] + 1)
        n = F.length(x["t"])
        values = F.transform(F.split(x["t"], "(?!^)(?!$)"), lambda c: F.instr(alphabet, c) - 1)
        squares = F.aggregate(F.split(alphabet, "(?!^)(?!$)"), F.lit(0.0), lambda total, c: total + F.pow(n - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(2)))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), n.cast("double").alias("n"), F.length(alphabet).cast("double").alias("a"), values.alias("v"), squares.alias("q"))

    def sums(x: Column) -> Column:
        mean = F.aggregate(x["v"], F.lit(0.0), lambda total, v: total + v) / x["n"]
        high = F.transform(x["v"], lambda v: (v >= x["a"] / 2).cast("int"))
        return F.struct(*(x[c].alias(c) for c in "seknavq"), mean.alias("m"), high.alias("h"))

    def statistics(x: Column) -> Column:
        ups = F.aggregate(x["h"], F.lit(0.0), lambda total, h: total + h)
        last = F.size(x["h"]) - 1
        runs = 1 + F.aggregate(F.zip_with(F.slice(x["h"], 1, last), F.slice(x["h"], 2, last), lambda a, b: (a != b).cast("int")), F.lit(0.0), lambda total, c: total + c)
        spread = F.aggregate(x["v"], F.lit(0.0), lambda total, v: total + (v - x["m"]) * (v - x["m"]))
        serial = F.aggregate(F.zip_with(F.slice(x["v"], 1, last), F.slice(x["v"], 2, last), lambda a, b: (a - x["m"]) * (b - x["m"])), F.lit(0.0), lambda total, c: total + c)
        return F.struct(*(x[c].alias(c) for c in "sekna"), (x["q"] * x["a"] / x["n"] - x["n"]).alias("chi"), ups.alias("u"), runs.alias("r"), spread.alias("d"), serial.alias("c"))

    def deviations(x: Column) -> Column:
        n, a = x["n"], x["a"]
        uniform = (x["chi"] - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        expected = 2 * x["u"] * (n - x["u"]) / n + 1
        deviation = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        runs = F.when((x["u"] != 0) & (x["u"] != n), (x["r"] - expected) / deviation)
        serial = F.when(x["d"] > 0, (x["c"] / x["d"] + 1 / n) * F.sqrt(n))
        return F.struct(*(x[c].alias(c) for c in "sekn"), F.array(uniform, F.abs(runs), F.abs(serial)).alias("z"))

    def tails(x: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in "sekn"), F.transform(x["z"], lambda z: F.when(z.isNotNull(), _upper(z))).alias("p"))

    def combined(x: Column) -> Column:
        half = -(F.ln(x["p"][0]) + F.ln(_two_sided(x["p"][1])) + F.ln(_two_sided(x["p"][2])))  # Fisher: half of a chi-squared statistic with 6 degrees
        return F.struct(*(x[c].alias(c) for c in "sekn"), half.alias("half"))

    def judged(x: Column) -> Column:
        half = x["half"]
        p = F.exp(-half) * (1 + half + half * half / 2)
        band = x["k"] * 100 + F.floor(2 * F.log2(x["n"])).cast("int")
        level = F.floor(-F.log10(F.greatest(p, F.lit(1e-12))) * CLASSES).cast("int")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), band.alias("band"), level.alias("level"))

    for step in (symbols, sums, statistics, deviations, tails, combined, judged):
        first = F.transform(first, step)
    return first[0]


def _candidates(df: DataFrame) -> DataFrame:
    """df with ``tested``: (s, e, band, level) of each token in text that may be an encoded secret."""
    df = _located(df, "_tokens", TOKEN)
    fit = F.filter("_tokens", lambda x: x["t"].rlike("[0-9]") & x["t"].rlike("[A-Za-z]"))
    return df.withColumn("_fit", fit).withColumn("tested", F.transform("_fit", _tested)).drop("_tokens", "_fit")


def rejections(docs: DataFrame, share: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """By band, the least level of p-values at which a token is rejected as not random: Benjamini and Hochberg's
    rule among the band's tokens of the whole corpus, over counts of p-values by class.

    A band is an encoding and half an octave of length, so long tokens, whose tests see more,
    are judged among their like. The driver gets a row for each band at most.
    """
    # only tokens come out of the scan; their counts combine before the shuffle
    texts = docs.select("text").where(F.col("text").rlike(TOKEN))
    counts = _candidates(texts).select(F.explode("tested").alias("x")).groupBy("x.band", "x.level").agg(F.count("*").alias("n"))
    up = Window.partitionBy("band").orderBy(F.desc("level"))
    ranked = counts.withColumn("rank", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    edge = F.pow(F.lit(10.0), -F.col("level") / CLASSES)  # the largest p of the class
    rejected = ranked.where(edge <= share * F.col("rank") / F.col("all")).groupBy("band").agg(F.min("level").alias("level"))
    return {r["band"]: r["level"] for r in rejected.collect()}


def found(docs: DataFrame, rejected: dict[int, int] | None = None) -> DataFrame:
    """``docs`` with base and spans: arrays of (s, k, e), sorted: start, index in KINDS, end, in code points.

    base are the known shapes; spans adds the tokens that the battery doesn't reject and that
    meet no base span. Null texts have none, repeated rows stay; a column of ``docs`` called
    base or spans gives way.
    """
    rejected = rejections(docs) if rejected is None else rejected
    df = docs.withColumn("_own", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX)):
        df = _located(df, name, pattern)
    kept = F.filter("_assign", lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= 12)
    spans = lambda c, k: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    df = df.withColumn("base", F.array_sort(F.concat(spans(kept, 0), spans(F.col("_access"), 1), spans(F.col("_hex"), 2))))
    df = _candidates(df)
    limits = F.create_map(*(F.lit(x) for pair in rejected.items() for x in pair)) if rejected else F.lit(None).cast("map<int,int>")
    random = F.filter(
        "tested",
        lambda x: (x["level"] < F.coalesce(F.try_element_at(limits, x["band"]), F.lit(1 << 20))) & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])),
    )
    df = df.withColumn("spans", F.array_sort(F.concat("base", spans(random, 3))))
    return df.withColumn("text", F.col("_own")).drop("_own", "_assign", "_access", "_hex", "tested")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with [SECRET] for each span; spans that overlap make one gap."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        piece = F.when(x["s"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, x["s"] - state["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    rest = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, add, rest)).otherwise(text)
