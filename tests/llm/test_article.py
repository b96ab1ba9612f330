"""Main text of small pages, and of the given pages against their known template."""

import html
import os
import re

import numpy as np
import pytest

from tablegauge.llm import article

PAGES = "/root/testdata/sf0.001/pages.parquet"
LONG = "A paragraph with a good many words that goes on for a while and then some more words."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, text",
    [
        (f"<article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>&copy; x</footer>", f"Title {LONG} Short."),
        (f"<nav><a href=/>Home</a></nav><article><p>a&amp;b <b>bold</b>ly\n\t x</p></article>", "a&b boldly x"),
        (f"<div class='sidebar'><p>{LONG}</p></div><div class=content><p>{LONG}</p></div>", LONG),
        (f"<main><p>{LONG}</p><form><p>Your mail</p></form><section id=comments><p>{LONG} {LONG}</p></section></main>", LONG),
        (f"<header><h1>Site</h1></header><div class='cookie-notice'>{LONG}</div><div class='ad'>{LONG}</div><article><p>Be.</p></article>", "Be."),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p><!-- <p>no</p> --><aside>{LONG}</aside></article>", f"Title {LONG}"),
        ("", ""),
    ],
)
def test_small_pages(body, text):
    assert article.main_text(page(body)) == text


def test_tree_fits_its_table():
    table = np.array([row.split() for row in article.TABLE.split("\n") if row], dtype=float)
    assert (article.judged(article.trained(), table[:, :-1]) == (table[:, -1] == 1)).all()


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_given_pages(spark):
    for row in article.extracted(spark.read.parquet(PAGES)).join(spark.read.parquet(PAGES).drop("url"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        inner = re.sub(r"<(?:/?p|br|/?h1)>", " ", inner).replace("<b>", "").replace("</b>", "")
        assert row.text == " ".join(html.unescape(inner).split()) and row.n_chars == len(row.text)


def test_frames(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (None, "u", "plain " * 200000), (3, "v", page("<article><p>x</p></article>")), (3, "v", page("<article><p>x</p></article>"))]
    pages = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in article.extracted(pages).collect()), key=str)
    assert len(got) == 6 and (1, "u", "", 0) in got and (2, None, "", 0) in got and got.count((3, "v", "x", 1)) == 2
    assert article.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "body, text",
    [
        ('<p>One <svg class="i"/> two.</p><p>Three words here.</p>', "One two. Three words here."),
        ("<p>One <svg><path d='x'/><text>no</text></svg> two.</p>", "One two."),
        ("<p>One.</p><div><button>More</div><p>Three words.</p>", "One. Three words."),
        ("<p>One <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two <object>shown</object>.</p>", "One x=2 two shown."),
        ("<p>One.</p><select><option>no</select><template><p>no</p></template><p>Two.</p><script>var t = '<p>no'", "One. Two."),
    ],
)
def test_unseen_elements_end(body, text):
    assert article.main_text(page(f"<article>{body}</article>")) == text
