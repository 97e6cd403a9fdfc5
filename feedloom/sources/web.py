"""Web pages: safe URLs, links, extraction of text, and a bounded crawl over stored pages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from feedloom.functions.text import stripped
from feedloom.storage import stored

#: The first byte, or first two, of IPv4 addresses that are private, loopback, link-local, shared, multicast, reserved or unspecified.
OWN_FIRST = ("0", "10", "127", *map(str, range(224, 256)))
OWN_FIRST_TWO = ("169.254", "192.168", "192.0", "198.18", "198.19", *(f"172.{n}" for n in range(16, 32)), *(f"100.{n}" for n in range(64, 128)))
#: A plain name: labels of letters, digits and hyphens, the last one not all digits nor a hexadecimal number.
NAME = r"^([a-z0-9_]([a-z0-9_-]*[a-z0-9_])?\.)*[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?\.?$"
NUMERIC_END = r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"
ADDRESS = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
# What the HTML of pages holds that ask whether the reader is a robot.
CHALLENGES = ("g-recaptcha", "cf-challenge", "captcha-delivery", 'id="challenge-running"')
SKIPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside"}
#: Skipped elements that no reader sees: nothing in them is text, closed or not. Elements that begin a page's text; those without an end.
UNSEEN = {"script", "style", "noscript", "template"}
BODIES = {"p", "article"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PAGE = StructType([StructField(n, StringType()) for n in ("title", "body", "author", "date", "site", "status")])
BLOCKS = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "td"}


def host(url: Column) -> Column:
    """The host of a URL in lower case: what stands after the user's name, before the port; an address in brackets with them. Empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:@\[\]]*)(?::[0-9]*)?$", 1))


def safe(url: Column, http: bool = False) -> Column:
    """https (or http) and a host that is a plain name or a public IPv4 address written in four decimal parts.

    Refused: addresses of the own network, in brackets, or in any other notation (one number, octal,
    hexadecimal), names that end in a number, and localhost. Names are not resolved. Null is unsafe.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))

    def public(h: Column) -> Column:
        own = F.substring_index(h, ".", 1).isin(*OWN_FIRST) | F.substring_index(h, ".", 2).isin(*OWN_FIRST_TWO)
        named = h.rlike(NAME) & ~h.rlike(NUMERIC_END) & ~h.rlike(r"(^|\.)localhost\.?$")
        return (h != "") & (named | (h.rlike(ADDRESS) & ~own))

    return F.coalesce(scheme.isin("https", *(["http"] if http else [])) & F.transform(F.array(host(url)), public)[0], F.lit(False))


def links(url: Column, html: Column) -> Column:
    """The distinct http(s) targets of a page; paths from the root are made absolute."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    found = F.regexp_extract_all(html, F.lit('href="([^"#]+)'), F.lit(1))
    whole = F.transform(found, lambda h: F.when(h.rlike("^https?://"), h).when(h.rlike("^/[^/]|^/$"), F.concat(root, h)))
    return F.array_distinct(F.array_compact(whole))


class _Page(HTMLParser):
    """Parts of a page's text. What stands in a skipped element goes with its end tag; of one that isn't closed before its
    parent (or the page) ends, only what comes before its first paragraph, article or main part goes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.in_title, self.title, self.parts, self.meta = False, [], [], {}
        # open elements; of a skipped one where its text starts, and where its first paragraph does
        self.open: list[tuple[str, list[int | None] | None]] = []
        self.count, self.waiting = Counter(), []  # open elements by tag; skipped ones without a paragraph so far

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name, a.get("content"))
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            if tag in BODIES:
                self._body_starts()
            self.parts.append("\n")
        elif tag == "main":
            self._body_starts()
        if tag not in VOID:
            skip = [len(self.parts), None] if tag in SKIPPED else None
            self.open.append((tag, skip))
            self.count[tag] += 1
            if skip and tag not in UNSEEN:
                self.waiting.append(skip)

    def _body_starts(self):
        for skip in self.waiting:
            skip[1] = len(self.parts)
        self.waiting = []

    def _pop(self):
        tag, skip = self.open.pop()
        self.count[tag] -= 1
        return skip

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in BLOCKS:
            self.parts.append("\n")
        if self.count[tag]:
            while self.open[-1][0] != tag:
                self._unclosed(self._pop())
            if skip := self._pop():
                del self.parts[skip[0] :]
                if tag not in UNSEEN:
                    self.parts.append("\n")

    def _unclosed(self, skip):
        if skip:
            del self.parts[skip[0] : skip[1]]

    def handle_data(self, data):
        (self.title if self.in_title else self.parts).append(data)

    def close(self):
        super().close()
        while self.open:
            self._unclosed(self._pop())


def page(html: str | None) -> dict:
    if not html or not html.strip():
        return {"title": None, "body": None, "author": None, "date": None, "site": None, "status": "empty"}
    p = _Page()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    body = "\n".join(x for x in lines if x)
    date = p.meta.get("article:published_time") or p.meta.get("date")
    return {"title": " ".join("".join(p.title).split()) or None, "body": body or None, "author": p.meta.get("author"), "date": date, "site": p.meta.get("og:site_name"), "status": "ok" if body else "no_extractable"}


@pandas_udf(PAGE)
def extracted(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What a page says of itself, and its text without scripts, styles and navigation."""
    for batch in html:
        yield pd.DataFrame([page(h) for h in batch], columns=["title", "body", "author", "date", "site", "status"])


@pandas_udf(StringType())
def plain(html: pd.Series) -> pd.Series:
    """Text content of an HTML fragment; null if blank."""
    return html.map(lambda h: page(h)["body"], na_action="ignore")


def page_date(text: Column) -> Column:
    """Dates as ISO time, ISO day, or day of month with the month's name."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("d MMMM yyyy"))).cast("date")


def items(pages: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Raw items of pages (url, html[, content_type]); a crawl leaves out the pages without text, a fixed list keeps them.

    What is declared to be something else than HTML isn't read: its status is wrong_content_type.
    """
    html = F.col("html")
    other = F.lit(False)
    if "content_type" in pages.columns:
        other = F.coalesce(~F.lower("content_type").rlike(r"^\s*(text/html|application/xhtml\+xml)\s*(;|$)"), F.lit(False))
    df = pages.select("url", other.alias("_other"), extracted(F.when(~other, html)).alias("x")).select(F.sha2("url", 256).alias("external_id"), "url", "_other", "x.*")
    df = df.withColumn("status", F.when(F.col("_other"), "wrong_content_type").otherwise(F.col("status"))).drop("_other")
    df = df.withColumn("published_on", page_date(F.col("date"))).drop("date")
    return df if keep_empty else df.where(stripped(F.coalesce("body", F.lit(""))) != "")


def listed(urls: DataFrame, start: int = 0) -> DataFrame:
    """(url, index) of a fixed list (url, at): each URL once, at its first place; from the index ``start`` on, where a run that was cut off resumes."""
    first = urls.where("url is not null").groupBy("url").agg(F.min("at").alias("at"))
    order = Window.orderBy("at", "url")  # a configured list, short by nature
    return first.withColumn("index", F.row_number().over(order) - 1).where(F.col("index") >= start).select("url", "index")


def challenged(html: Column) -> Column:
    """Whether a page is a barrier to robots and not the page that was asked for."""
    return F.coalesce(reduce(or_, (F.contains(html, F.lit(m)) for m in CHALLENGES)), F.lit(False))


def crawl(pages: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(url, depth): the pages that links lead to from the seeds (url), on the seeds' hosts, with the least number of steps.

    Each step joins the frontier with the pages' links and takes off what has been seen: two
    equi-joins, whose cost is that of the pages reached and not of all.
    """
    spread = pages.select("url", F.explode(links(F.col("url"), F.col("html"))).alias("target")).distinct()
    edges = stored(spread.join(pages.select(F.col("url").alias("target")).distinct(), "target").where(host(F.col("url")) == host(F.col("target"))))
    seen = stored(seeds.select("url").distinct().join(pages.select("url").distinct(), "url", "left_semi").withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        frontier = seen.where(F.col("depth") == step - 1).select("url")
        new = edges.join(frontier, "url", "left_semi").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = stored(seen.unionByName(new.withColumn("depth", F.lit(step))))
    return seen
