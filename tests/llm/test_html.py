import re
from html import unescape

import pytest

from parley.llm.html import extract, gaussian, main_text

ARTICLE = "<h1>A title</h1><p>First <b>para</b>graph with some words &amp; a sign.<p>Short.</p><ul><li>one</li><li>two</li></ul>" \
          "<p>Another  long\nparagraph&nbsp;that <a href='/x'>links</a> somewhere and goes on for a while.</p>"
TEXT = "A title First paragraph with some words & a sign. Short. one two " \
       "Another long paragraph that links somewhere and goes on for a while."
MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(6)) + "</ul></nav>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{MENU}"
    f"<div class='ad'>Buy this now, it is cheap.</div><article>{ARTICLE}</article><footer>&copy; all</footer>",
    f"<body><header><h2>Site name</h2></header>{MENU}<main>{ARTICLE}<section id='comments'><p>Nice one!</p></section>"
    f"<form><p>Write to us</p></form></main><aside>Side words that are many and long enough to count</aside>",
    f"<body><div id='top-nav'>Home | News</div><div class='cookie-notice'>We use cookies on this page.</div>"
    f"<div class='content'><div class='post-body'>{ARTICLE}</div><div class='sidebarRight'>More things to read here</div>"
    f"</div><div role='contentinfo'>Imprint</div></body>",
    f"<article><header><div class='share'>Tell a friend</div></header>{ARTICLE}<article class='comment'><p>I say so too, "
    f"and at length.</p></article></article>",
])
def test_article_alone(page):
    assert main_text(page) == TEXT


SENTENCE = "The council of the harbour town met and spoke for a long while about nets, boats and quotas that nobody wanted. "
BODY = "".join(f"<p>{SENTENCE * (1 + i % 2)}</p>" for i in range(4))
PLAIN = " ".join((SENTENCE * (1 + i % 2)).strip() for i in range(4))
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("page, text", [
    # Ends that a page may leave out.
    (f"<html><head><title>T</title><meta name=x>{BODY}", PLAIN),
    (f"<head><title>T</title>{PLAIN}", PLAIN),
    (f"<body><p class=ad>Buy{BODY}", PLAIN),
    (f"<ul><li class=share>Share<li>{PLAIN}</ul>", PLAIN),
    (f"<dl><dt class=ad>Buy<dd>{PLAIN}</dl>", PLAIN),
    (f"<table><tr><td class=sidebar>{LINKS}<td>{BODY}</table>", PLAIN),
    (f"<nav>{LINKS}<main>{BODY}</main>", PLAIN),
    (f"<article><b><p>{PLAIN}</b> more</p></article>", PLAIN + " more"),
    # Forms and class words.
    (f"<body><form action=x><input name=q>{BODY}<label>Name</label><select><option>a<option>b</select></form>", PLAIN),
    (f"<body><form><div class='ad'>Buy this</div>{BODY}</form>", PLAIN),
    (f"<body><h1>Short</h1><div class='legal-analysis'>{BODY}</div>", PLAIN),
    (f"<body><div class='notice'>{BODY}</div>", PLAIN),
    (f"<body><div>{BODY}</div><div class='legal-notes'><p>Short words.</p></div>", PLAIN),
    (f"<body><div>{BODY}</div><div id=comments>{BODY * 3}</div>", PLAIN),
    (f"<div class=comments>{BODY}</div>", ""),
    ("<div class=cookie-notice>We use cookies.</div>", ""),
    # Text beside an article, and pages without one.
    (f"<article><p>A teaser.</p></article><div>{BODY}<p>End.</p></div>", f"A teaser. {PLAIN} End."),
    (f"<p>Made in 2020.</p><article>{BODY}</article><p>All rights reserved.</p>", PLAIN),
    (f"<body>{LINKS}<div>{BODY}<p>End.</p></div>{LINKS}", PLAIN + " End."),
    # Links and formulas of an article.
    (f"<article>{BODY}<p>See: <a href=x>The whole report of the council</a></p></article>",
     PLAIN + " See: The whole report of the council"),
    (f"<article>{BODY}<ul><li><a>Source one</a><li><a>Source two</a><li><a>Source three</a></ul></article>",
     PLAIN + " Source one Source two Source three"),
    (f"<article>{BODY}<div>{LINKS}</div></article>", PLAIN),
    (f"<article>{BODY}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", PLAIN + " So x=1 holds."),
])
def test_pages_without_the_usual_marks(page, text):
    assert main_text(page) == text


def test_odd_pages():
    assert main_text("") == "" and main_text("<nav>menu</nav>") == "" and main_text("just words") == "just words"
    assert main_text("<p>a < b &lt;i&gt; &#233;&#x4f60; &bogus; <") == "a < b <i> é你 &bogus; <"
    long = "word " * 100_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main_text("<p>" * 20_000 + "x") == "x"


def test_gaussian_keeps_constants():
    assert gaussian([2.0] * 9, 1.5).round(12).tolist() == [2.0] * 9


def test_rows_and_whole_pages(spark):
    rows = [(1, "u", "<article><p>Body</p></article>", "t"), (2, None, None, "t"), (None, "v", "", "t"),
            (1, "u", "<article><p>Body</p></article>", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "u", "Body", 4)] * 2 + [(2, None, "", 0), (None, "v", "", 0)]))
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    for r in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), keep=("page_id", "html")).collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]  # the template of these pages
        want = " ".join(unescape(re.sub(r"<(?:/?p|/?h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want)
