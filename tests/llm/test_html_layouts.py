"""Hand-written layouts, each with the article that a reader would see in it."""

import html
import re

import duckdb
import pytest

from quarrymill.llm import html_mincut

LONG = "This is a sentence of the article with a good many words in it."
MORE = "Here is another one, which goes on with what the first one has said."
LAYOUTS = {
    "short paragraphs only": ("<body><h1>Title</h1><p>First short one.</p><p>Second short text here.</p><p>Another one that is a bit longer than the rest of them, really.</p></body>", "Title First short one. Second short text here. Another one that is a bit longer than the rest of them, really."),
    "divisions only": (f"<div id='wrap'><h1>Head</h1><div class='txt'>{LONG}</div><div class='txt'>{MORE}</div></div>", f"Head {LONG} {MORE}"),
    "one division": ('<div class="content"><div>A sentence of eleven words stands here in a div alone.</div></div>', "A sentence of eleven words stands here in a div alone."),
    "a form around the page": (f'<form id="aspnetForm"><div id="nav"><a href="/">Home</a> <a href="/b">About</a></div><h1>Head</h1><p>{LONG}</p><p>{MORE}</p><input type=submit></form>', f"Head {LONG} {MORE}"),
    "lists in the article": (f"<article><h1>Cake</h1><p>{LONG}</p><ul><li>Two eggs</li><li>Flour</li><li>A cup of milk</li></ul><ol><li>Mix</li><li>Bake it for an hour.</li></ol></article>", f"Cake {LONG} Two eggs Flour A cup of milk Mix Bake it for an hour."),
    "a table in the article": (f"<article><p>{LONG}</p><table><caption>Rates</caption><tr><th>Year</th><th>Rate</th></tr><tr><td>2001</td><td>5</td></tr><tr><td>2002</td><td>7</td></tr></table></article>", f"{LONG} Rates Year Rate 2001 5 2002 7"),
    "terms and definitions": (f"<main><p>{LONG}</p><dl><dt>Node</dt><dd>A point of a graph.</dd><dt>Edge</dt><dd>A line</dd></dl></main>", f"{LONG} Node A point of a graph. Edge A line"),
    "quotation and code": (f"<article><p>{LONG}</p><blockquote>So it goes</blockquote><pre>x = 1\n  y = 2</pre></article>", f"{LONG} So it goes x = 1 y = 2"),
    "hidden parts of a line": (f"<article><p>{LONG} <span hidden>Not to be <b>seen</b></span>Shown. <i style='display: none'>Gone</i>End.</p></article>", f"{LONG} Shown. End."),
    "hidden blocks": (f"<article><p>{LONG}</p><div hidden><p>{MORE}</p></div><p aria-hidden='true'>Not to be seen by anyone.</p></article>", LONG),
    "navigation of plain divisions": (f"<div><a href=a>Home</a><a href=b>News</a><a href=c>Sport</a></div><div><h1>Head</h1><p>{LONG}</p></div>", f"Head {LONG}"),
    "lists of links": (f"<ul><li><a href=1>One page</a></li><li><a href=2>Another page of the site</a></li></ul><h2>Head</h2><p>{LONG}</p><ul><li><a href=3>Next</a></li></ul>", f"Head {LONG}"),
    "sidebars and footers by name": (f"<div class='main-content'><p>{LONG}</p></div><div class='sidebar'><p>Popular: {MORE}</p></div><div id='footer'><p>Written by people who like to write a lot of text.</p></div>", LONG),
    "sidebars and footers by tag": (f"<header><p>The tagline of this site is a sentence.</p></header><main><p>{LONG}</p></main><aside><p>{MORE}</p></aside><footer><p>Contact us by mail, or come and see us.</p></footer>", LONG),
    "reader comments": (f"<article><p>{LONG}</p></article><section id='comments'><h2>Comments</h2><div class='comment'><p>{MORE}</p></div></section>", LONG),
    "comments within the article": (f"<article><p>{LONG}</p><ol class='comment-list'><li>I have liked this a lot, thank you.</li></ol></article>", LONG),
    "a form within the article": (f"<article><p>{LONG}</p><form><label>Your mail</label><p>Send me news every week, please.</p></form><p>{MORE}</p></article>", f"{LONG} {MORE}"),
    "advertising between paragraphs": (f"<article><p>{LONG}</p><div class='ad-slot'>Buy this now, it is cheap and good.</div><p>{MORE}</p></article>", f"{LONG} {MORE}"),
    "a cookie notice": (f"<div id='cookie-banner'><p>We use cookies, and so do all the others, as you know.</p><button>Accept</button></div><p>{LONG}</p>", LONG),
    "copyright without a name": (f"<div><h1>Head</h1><p>{LONG}</p><p>{MORE}</p></div><div>© 2020 The Site. All rights reserved.</div>", f"Head {LONG} {MORE}"),
    "text in the body": (f"{LONG}<br>{MORE}", f"{LONG} {MORE}"),
    "one word": ("<p>Hi</p>", "Hi"),
    "one-word paragraphs beside the article": (f"<div class='story'><p>{LONG}</p><p>Stop.</p><p>{MORE}</p></div>", f"{LONG} Stop. {MORE}"),
    "many one-word paragraphs": (f"<article><p>{LONG}</p>" + "<p>Word</p>" * 40 + "</article>", LONG + " Word" * 40),
    "a line of names": (f"<div><p>{LONG}</p><p>Jane</p><p>John Doe</p><p>{MORE}</p></div><div class='widget'><p>Tags</p></div>", f"{LONG} Jane John Doe {MORE}"),
    "headings of sections": (f"<article><h2>One</h2><p>{LONG}</p><h3>Two</h3><p>{MORE}</p></article>", f"One {LONG} Two {MORE}"),
    "a caption of a figure": (f"<article><p>{LONG}</p><figure><img src=x><figcaption>A cat</figcaption></figure></article>", f"{LONG} A cat"),
    "links within the text": (f"<div><p>See <a href=x>this page</a> and <a href=y>that one</a> for all that has been said of it.</p><p>{LONG}</p></div>", f"See this page and that one for all that has been said of it. {LONG}"),
    "nothing but boilerplate": ("<nav><a href=a>Home</a></nav><footer>© me</footer>", ""),
    "nested tables for layout": (f"<table><tr><td><a href=1>Home</a></td><td><table><tr><td><h1>Head</h1><p>{LONG}</p></td></tr></table></td></tr></table>", f"Head {LONG}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html_mincut.main_text(page) == want
    assert html_mincut.main_text(f"<!doctype html><html><head><title>T</title></head><body>{page}</body></html>") == want


def test_the_cut_decides_in_several_layouts():
    decided = 0
    for page, _ in LAYOUTS.values():
        blocks = html_mincut.parse(page)
        score = html_mincut.scores(blocks)
        decided += [s > 0 for s in score] != html_mincut.minimum_cut(score, html_mincut.edges_of(blocks))
    assert decided >= 2


def test_long_tables_are_whole():
    rows = "".join(f"<tr><td>row {i}</td><td>{i * i}</td></tr>" for i in range(3000))
    want = " ".join(f"row {i} {i * i}" for i in range(3000))
    assert html_mincut.main_text(f"<article><p>{LONG}</p><table>{rows}</table></article>") == f"{LONG} {want}"


def test_given_pages():
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall():
        article = re.search("<article>(.*)</article>", page, re.S).group(1)
        assert html_mincut.main_text(page) == " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", article))).split())
