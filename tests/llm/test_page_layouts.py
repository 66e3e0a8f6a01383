"""Whole articles of many layouts: titles, leads, tables, code and figures stay, menus and reader comments go."""

from collections import Counter

import pytest

from ledgerline.llm import html_text as H

TALE = "plain words that tell of a thing and how it all went on from there to its end. " * 6
PROSE = f"<p>{TALE}</p>"
NAV = "<div><ul><li><a>home</a></li><li><a>news of the day</a></li><li><a>sport</a></li></ul></div>"
TABLE = "<table><tr><th>Year</th><th>Value</th></tr><tr><td>1999</td><td>12</td></tr></table>"
LINKS = "<div><ul><li><a>another tale</a></li><li><a>one more tale of old</a></li></ul></div>"
SAID = "I have read it twice and do not agree with the second part, but thank you all the same."
#: (page, its blocks); T is TALE, Y the table's rows.
PAGES = [
    (f"<article><h1>The title of it</h1><p>Intro line.</p>{TABLE}{PROSE}{TABLE}</article>", "The title of it|Intro line.|Y|T|Y"),
    (f"<main><h1>Title here</h1><p>Lead.</p>{LINKS}{PROSE}{PROSE}</main>", "Title here|Lead.|T|T"),
    (f"<h1>Howto</h1><p>Short.</p><pre><span>x = 1</span> <span>y = 2</span></pre>{PROSE}", "Howto|Short.|x = 1 y = 2|T"),
    (f"<article><h1>One</h1>{PROSE}<pre><code>for i in x: go</code></pre>{PROSE}</article>", "One|T|for i in x: go|T"),
    (f"<main><article><h1>One</h1><figure><img><figcaption>a tree</figcaption></figure>{PROSE}</article></main>", "One|a tree|T"),
    (f"<main><h1>All</h1><article><h2>First</h2>{PROSE}</article><article><h2>Second</h2>{PROSE}</article></main>", "All|First|T|Second|T"),
    (f"<article><header><h1>Head</h1><p>By some one</p></header><div><div>{PROSE}{PROSE}</div></div></article>", "Head|By some one|T|T"),
    (f"<article><h1>Point by point</h1>{PROSE}<ul><li>one point</li><li>other point</li></ul><blockquote>said she</blockquote></article>", "Point by point|T|one point|other point|said she"),
    (f"<div><h1>Title</h1><p>by me</p></div><div>{PROSE}{PROSE}</div>", "Title|by me|T|T"),
    (f"<article><h1>Facts</h1><dl><dt>born</dt><dd>long ago</dd></dl>{PROSE}</article>", "Facts|born|long ago|T"),
    (f"<article><h1>T</h1>{PROSE}{PROSE}<section><h3>3 responses</h3><div class='response'>{SAID}</div><div class='response'>{SAID} {SAID}</div><div class='response'><p>{SAID}</p></div></section></article>", "T|T|T"),
    (f"<article><h1>T</h1>{PROSE}{PROSE}</article><div><h2>Comments (2)</h2><div><p>{SAID}</p></div></div>", "T|T|T"),
    (f"<article><h1>T</h1>{PROSE}{PROSE}<div><div><div>Ann, 2024-01-02</div><p>{SAID}</p></div><div><div>Bob, 2024-01-03</div><p>{SAID}</p></div></div></article>", "T|T|T"),
    (f"<main><h1>T</h1>{PROSE}{PROSE}<ol><li><div><b>Ann</b> <time>now</time></div><p>{SAID}</p></li><li><div><b>Bob</b> <time>now</time></div><p>{SAID}</p></li></ol></main>", "T|T|T"),
    (f"<article><h1>T</h1>{PROSE}<h2>12 Kommentare</h2><div><p>{SAID}</p></div></article>", "T|T"),
    # what looks like comments and isn't
    (f"<article><h1>T</h1>{PROSE}<section><h3>3 reasons</h3><div>first of all</div><div>and then</div></section></article>", "T|T|3 reasons|first of all|and then"),
    (f"<article><h1>Changes</h1>{PROSE}<ul><li>2024-01-02: mended</li><li>2024-02-03: mended again</li></ul></article>", "Changes|T|2024-01-02: mended|2024-02-03: mended again"),
    (f"<article><h1>Comments on law and its makers of old</h1>{PROSE}{PROSE}</article>", "Comments on law and its makers of old|T|T"),
    (f"<article><h1>T</h1>{PROSE}<h2>Response times of servers</h2>{PROSE}</article>", "T|T|Response times of servers|T"),
    (f"<article><p>Only a lead.</p>{PROSE}<table><tr><td>{TALE}</td></tr></table></article>", "Only a lead.|T|T"),
]


def blocks(told):
    return "\n\n".join({"T": TALE.strip(), "Y": "Year Value\n\n1999 12"}.get(x, x) if i or x != "T" else x for i, x in enumerate(told.split("|")))


@pytest.fixture(scope="module")
def weights():
    return H.fit(H.LABELLED * 4)


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_articles_are_whole_and_comments_go(weights, number):
    page, told = PAGES[number]
    for frame in ("{}", "<html><body>" + NAV + "{}" + LINKS + "</body></html>"):
        assert H.main_text(frame.format(page), weights) == blocks(told)


def test_precision_and_recall_of_words(weights):
    found = wanted = right = 0
    for page, told in PAGES:
        got, want = (Counter(x.split()) for x in (H.main_text(f"<html><body>{NAV}{page}{LINKS}</body></html>", weights), blocks(told)))
        found, wanted, right = found + got.total(), wanted + want.total(), right + (got & want).total()
    assert right >= 0.98 * found and right >= 0.98 * wanted
