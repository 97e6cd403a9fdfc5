"""Text of pages whose markup is broken."""

import time

import pytest

from feedloom.sources.web import page

CASES = {
    "<p>a</p><aside>x<p>body text</p>": "a\nbody text",
    "<nav><a>menu</a><p>text</p>": "text",
    "<nav><a>menu</a></nav><p>text</p>": "text",
    "<div><nav>menu<ul><li>one<li>two</ul></nav><p>text</div>": "text",
    "<div><nav>menu</div><p>text</p>": "text",
    "<nav><p>a paragraph of the menu</p></nav><p>text</p>": "text",
    "<aside>x<header>y<p>z</p></header></aside><p>text</p>": "text",
    "<header>top<main>text</main>": "text",
    "<header>top<article>one<footer>end</footer>two</article>": "one\ntwo",
    "<div><template><p>never</p></div><p>text</p>": "text",
    "<noscript><p>never</p>": None,
    "</nav></aside><p>text</p></p></div>": "text",
    "<p>one<br>two<img src=x>three": "one\ntwothree",
    "<nav>menu only": None,
    "<aside/><p>text</p>": "text",
    "<script>if (a < b) {'<p>'}</script><p>text</p>": "text",
}


@pytest.mark.parametrize("html", CASES)
def test_text_of_broken_markup(html):
    got = page(html)
    assert (got["body"], got["status"]) == (CASES[html], "ok" if CASES[html] else "no_extractable")


def test_many_unclosed_elements_take_little_time():
    started = time.monotonic()
    assert page("<p>x" * 50_000 + "<nav><p>y</b>" * 20_000 + "</i>" * 50_000)["status"] == "ok"
    assert time.monotonic() - started < 20
