"""Pages written by hand, each with the text that is expected of it."""

import html
import re

import duckdb
import pytest

from tessera.llm import html_text

P = "The mill stood by the river for as long as any of them could say, and it was the first thing that one saw from the road to the town."
Q = "When the rain came in the spring the water rose to the door, so that they had to leave it and go to the house of the smith."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>All of the news</a></li></ul></nav>"
FOOT = "<footer>© 2024 The Mill. All of the rights are with us.</footer>"
FINNISH = "Vanha mylly seisoi joen varrella niin kauan kuin kukaan muisti, ja se oli ensimmäinen asia, jonka tieltä kaupunkiin näki joka aamu."
POLISH = "Stary młyn stał nad rzeką tak długo, jak tylko ludzie pamiętali, i był pierwszą rzeczą, którą widać było z drogi do miasta każdego ranka."

PAGES = {
    "entry header": (f"<article><header class='entry-header'><h1 class='entry-title'>The mill</h1></header><p>{P}</p></article>", f"The mill {P}"),
    "page header": (f"<h1 class='page-header'>The mill</h1><p>{P}</p><p>{Q}</p>", f"The mill {P} {Q}"),
    "post header in a div": (f"<div class='post-header'><h2>The mill</h2></div><div class='post-body'><p>{P}</p><p>{Q}</p></div>", f"The mill {P} {Q}"),
    "related work": (f"<article><p>{P}</p><section id='related-work'><h2>Related work</h2><p>{Q}</p></section></article>", f"{P} Related work {Q}"),
    "market share": (f"<article><p>{P}</p><section id='market-share'><p>{Q}</p></section></article>", f"{P} {Q}"),
    "social history": (f"<article><div class='social-history'><p>{Q}</p></div><p>{P}</p></article>", f"{Q} {P}"),
    "notice board": (f"<article><p class='notice-board'>{P}</p><p>{Q}</p></article>", f"{P} {Q}"),
    "compound name without article": (f"<div><p>{P}</p></div><div class='banner-history'><p>{Q}</p></div>", f"{P} {Q}"),
    "sign in prose": ("<article><p>The photo © Ann Miller shows the mill as it was in that year, with the river in front of it.</p></article>", "The photo © Ann Miller shows the mill as it was in that year, with the river in front of it."),
    "sign at the start of prose": (f"<article><p>{P}</p><p>© is the sign that is put before the name of the one who holds the right in a work.</p></article>", f"{P} © is the sign that is put before the name of the one who holds the right in a work."),
    "notice of rights in an article": (f"<article><p>{P}</p><p>© 2021 Mill Press</p></article>", P),
    "copyright word": (f"<article><p>{P}</p><p>Copyright © 2019 by the Mill Press, all rights reserved</p></article>", P),
    "formula": (f"<article><p>{P}</p><p>The area is <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>a=b</annotation></math> as it was of old.</p></article>", f"{P} The area is a=b as it was of old."),
    "object": (f"<article><p>{P}</p><object data='x.swf'><p>{Q}</p></object></article>", f"{P} {Q}"),
    "button in a sentence": ("<article><p>Press the key that is named <button>Start</button> to begin with the work of the day, and wait.</p></article>", "Press the key that is named Start to begin with the work of the day, and wait."),
    "buttons alone": (f"<article><p>{P}</p><div><button>Share</button> <button>Print</button></div></article>", P),
    "list of links in an article": (f"<article><p>{P}</p><ul><li><a href='/1'>The first mill</a></li><li><a href='/2'>The second mill</a></li></ul><p>{Q}</p></article>", f"{P} The first mill The second mill {Q}"),
    "list of links outside": (f"<div><p>{P}</p></div><ul><li><a href='/1'>The first mill</a></li><li><a href='/2'>The second mill</a></li></ul>", P),
    "related posts": (f"<article><p>{P}</p><div class='related-posts'><a href='/1'>The first mill</a></div></article>", P),
    "share buttons": (f"<article><p>{P}</p><div class='share-this'>Share this with all of your friends</div></article>", P),
    "newsletter box": (f"<article><p>{P}</p><div class='newsletter-signup'><p>Have the news of the day in your mail each morning, it is free for all of you.</p></div></article>", P),
    "finnish": (f"<h1>Mylly</h1><p>{FINNISH}</p>", f"Mylly {FINNISH}"),
    "polish": (f"<h1>Młyn</h1><p>{POLISH}</p>", f"Młyn {POLISH}"),
    "polish article": (f"<main><h1>Młyn</h1><p>{POLISH}</p><p>Koniec.</p></main>", f"Młyn {POLISH} Koniec."),
    "three short lines": ("<p>One line.</p><p>And a second.</p><p>The third.</p>", "One line. And a second. The third."),
    "one short line": ("<div>Closed today.</div>", "Closed today."),
    "short lines in an article": ("<article><h1>Rain</h1><p>It fell.</p><p>We ran.</p></article>", "Rain It fell. We ran."),
    "quote and list": (f"<article><p>{P}</p><blockquote>So be it.</blockquote><ul><li>corn</li><li>rye</li></ul><p>{Q}</p></article>", f"{P} So be it. corn rye {Q}"),
    "table": (f"<article><p>{P}</p><table><tr><th>Year</th><td>1801</td></tr></table><p>{Q}</p></article>", f"{P} Year 1801 {Q}"),
    "comments": (f"<article><p>{P}</p></article><section class='comment-list'><p>{Q}</p></section>", P),
    "cookie notice": (f"<div id='cookie-notice'><p>{Q}</p></div><article><p>{P}</p></article>", P),
    "sidebar": (f"<div class='content'><p>{P}</p></div><div class='right-sidebar'><p>So many of the old mills are gone.</p></div>", P),
    "ad": (f"<div class='ad'>{Q}</div><article><p>{P}</p></article>", P),
    "site header": (f"<div class='site-header'>The news of the town</div><article><p>{P}</p></article>", P),
    "pre and references": (f"<article><p>{P}</p><pre>a &lt; b\n  c</pre></article>", f"{P} a < b c"),
    "link in prose": (f"<p>{P} <a href='/x'>More</a></p><p>{Q}</p>", f"{P} More {Q}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    body, want = PAGES[name]
    assert html_text.extract(f"<html><head><title>x</title></head><body>{NAV}{body}{FOOT}</body></html>") == want


def test_all_given_pages_keep_exactly_the_article():
    for page in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall():
        body = page[0][page[0].index("<article>") : page[0].find("</article>")]
        want = " ".join(html.unescape(re.sub(r"<(/?b)>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())
        assert html_text.extract(page[0]) == want
