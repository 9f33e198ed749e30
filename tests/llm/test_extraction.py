"""Main text: the cut against all labellings, pages of several layouts, broken and very long markup, the given pages against their article element."""

from __future__ import annotations

import html
import itertools
import random
import re
import time

import pytest

from marketlens.llm import extraction
from marketlens.llm.common import table

ONE = "The first paragraph tells at length what happened in the town on that day."
TWO = "A second one goes on with it, and it is quite as long as the one before."
SHORT = "Indeed."
FRAME = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar"><header><a href="/">Site</a><p>Slogan of the site that is a whole sentence.</p></header>'
    '<nav><ul><li><a href="/a">Home</a></li><li>News</li></ul></nav>{}<footer>&copy; 2020 Somebody. All rights reserved, with a long line of text about it.</footer></body></html>'
)
BODY = f"<h1>A title</h1><p>{ONE}</p><p>{SHORT}</p><p>{TWO}</p>"
WANTED = f"A title\n\n{ONE}\n\n{SHORT}\n\n{TWO}"
LONG = "A very long remark that goes on and on, sentence after sentence, as if it were the article itself. " * 9


@pytest.mark.parametrize("seed", range(8))
def test_cut_is_minimal(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(1, 9)
        costs = [rng.choice([0, rng.randrange(-9, 10)]) for _ in range(n)]
        edges = [(a, b, rng.randrange(1, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def energy(labels):
            return sum(abs(c) for c, x in zip(costs, labels) if c and x != (c > 0)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        least = min(energy(x) for x in itertools.product([False, True], repeat=n))
        assert energy(extraction.minimum_cut(costs, edges)) == least and energy(extraction.source_side(costs, edges)) == least


@pytest.mark.parametrize(
    "middle",
    [
        f"<article>{BODY}</article>",
        f"<main>{BODY}</main>",
        f'<div id="content"><div class="post-body">{BODY}</div></div>',
        f"<div>{BODY}</div>",
        f'<div class="layout sidebar-left"><article>{BODY}</article><div class="sidebar"><p>{LONG}</p></div></div>',
        f'<form action="/x"><article>{BODY}</article><input name=a><button>Send it now please</button></form>',
        f'<article><header><h1>A title</h1></header><p>{ONE}<div class="ad"><p>{LONG}</p></div><p>{SHORT}<p>{TWO}<script>var t="</p>";</script></article>',
        f'<article>{BODY}<section class="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article></section></article>',
        f"<article>{BODY}</article><section><h3>3 Comments</h3><p>{LONG}</p><p>{LONG}</p></section>",
        f'<article>{BODY}<aside>{LONG}</aside><form><label>Your name</label><textarea>{LONG}</textarea><select><option>{LONG}</select></form></article><div class="cookie-notice">{LONG}</div>',
        f'<article>{BODY}</article><div class="related"><article><p>{LONG}</p></article></div>',
        f'<article>{BODY}<p hidden>{LONG}</p><p style="display: none">{LONG}</p><noscript>{LONG}</noscript><template><p>{LONG}</template></article>',
    ],
)
def test_layouts(middle):
    assert extraction.main_text(FRAME.replace("{}", middle)) == WANTED


def test_markup():
    read = extraction.main_text
    assert read(f"<article><p>{ONE}<br>and&nbsp;&lt;b&gt; &AMP; &amp;lt; x&#233;\n\t <b>bo</b>ld</p><!-- <p>no</p> --><p title='a > b'>{TWO}") == f"{ONE} and <b> & &lt; xé bold\n\n{TWO}"
    assert read(f"<article><p>{ONE}</p><p class=\"open>{TWO}</p></article>").startswith(ONE)
    assert read(f"<article><p>{ONE}</p><script>x") == ONE and read(f"<article><p>{ONE}</p><!-- x") == ONE and read(f"<article><p>{ONE}</p><p cl") == ONE
    assert read(f"<table><tr><td>{ONE}<td>{TWO}<tr><td>{ONE}</table>") == f"{ONE}\n\n{TWO}\n\n{ONE}"
    assert read(f"<ul><li>{ONE}<ul><li>{TWO}</ul><li>{ONE}</ul>") == f"{ONE}\n\n{TWO}\n\n{ONE}"
    assert read(ONE) == ONE and read("a < b and <3 " + ONE) == "a < b and <3 " + ONE
    assert read(None) == read("") == read(" \n") == read("<p></p>") == read("<nav>Home</nav>") == ""


@pytest.mark.parametrize("piece", ["<div>", "<p>x</p>", "<b>", "</section>", "<a href=\"", "<!--", "<", "<p>some words. ", "<i><div></i>", "<div class='ad'>x</div><p>y z</p>", "<ul><li>a", "&amp", "<script>", "<li><a href=x>x</a>", "<p a='", "<td>x<tr>"])
def test_long_broken_pages_take_linear_time(piece):
    began = time.time()
    extraction.main_text(piece * 40_000)
    assert time.time() - began < 30


def test_queries_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x", 3), (1, "u", f"<article>{BODY}</article>", "x", 3), (None, None, None, None, None), (2, "v", "", "x", 3), (3, None, "<p>𝒳 " + ONE, "x", 3)]
    found = extraction.digest(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in found) == sorted([("1", "u", WANTED, len(WANTED))] * 2 + [("None", "None", "", 0), ("2", "v", "", 0), ("3", "None", "𝒳 " + ONE, len(ONE) + 2)])
    assert extraction.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    """Pages of the tables have an article element of h1, p, b and br."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
        assert found[r.page_id] == "\n\n".join(p for p in parts if p)
