import random
import re
from html.parser import HTMLParser

import pytest

from tessera.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">The home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- ad --><div class="ad">Buy the best of all and be happy with it.</div>
<article><h1>On the life of cats &amp; dogs</h1><p><b>The cat sat on the mat, and the dog was not amused by any of it at all.<br>
<p>It   was a <i>fine</i>ly made&nbsp;mat of the old kind, which they had had for years and years.</p><p>So be it.</p>
<div class="share-buttons">Share this with all of your friends and the rest of the world, please do it now.</div></article>
<div id="comments"><p>I was the first to comment on this and I think that it is the best of all.</p></div>
<form><p>Sign up for the news of the day and have it in your mail each morning.</p></form>
<footer>&copy; the owner</footer></body></html>"""


def test_page_by_hand():
    assert html_text.extract(PAGE) == (
        "On the life of cats & dogs The cat sat on the mat, and the dog was not amused by any of it at all. "
        "It was a finely made mat of the old kind, which they had had for years and years. So be it."
    )


def test_plain_page_without_article():
    page = "<body><div><a href='x'>Home</a> <a>News</a></div><p>Short one.</p><p>This is the text of a page that has no article tag, but it has enough of the usual words in it.</p><p>End.</p><div>Imprint</div>"
    assert "This is the text" in html_text.extract(page) and "News" not in html_text.extract(page)


def test_edges(spark):
    pages = [None, "", "<p", "<script>x", "no tags at all", "<p>&lt;b&gt; &#233; &am", "<div>" * 3000 + "deep words of the page", "<p>x<p>y" * 2000, PAGE[:-300], "a < b and <!-- open"]
    df = spark.createDataFrame([(i, None, p, "t") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    assert len(got) == len(pages) and got[0].text == got[1].text == got[2].text == got[3].text == "" and got[0].n_chars == 0
    assert got[4].text == "no tags at all" and got[5].text == "<b> é &am" and got[9].text == "a < b and"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_given_pages_keep_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract_pages(pages.limit(60)).join(pages, "page_id").collect():
        body = r.html[r.html.index("<article>") : r.html.find("</article>")]
        import html

        want = " ".join(html.unescape(re.sub(r"<(/?b)>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())
        assert r.text == want


ARTICLE = "<h1>On cats</h1><p>The cat sat on the mat, and the dog was not amused by any of it at all, which is how it has been for years.</p><p>It was the end of a long day for all of them, so they went to their beds and slept until the sun was up.</p>"
TEXT = "On cats The cat sat on the mat, and the dog was not amused by any of it at all, which is how it has been for years. It was the end of a long day for all of them, so they went to their beds and slept until the sun was up."
NAV = "<nav><a href='/'>Home</a> <a href='/x'>All of the news</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{NAV}<article class='overflow-hidden'>{ARTICLE}</article>",
        f"<body>{NAV}<div style='overflow:hidden'>{ARTICLE}</div>",
        f"<body><form action='/x'>{NAV}<div>{ARTICLE}</div><input name=q></form>",
        f"<body>{NAV}<article><header>{ARTICLE[:16]}</header>{ARTICLE[16:]}<footer>By the author of this and of all the others that are in it</footer></article>",
        f"<body><nav>{'<span>' * 1000}Menu of the day</nav><article>{ARTICLE}</article>",
        f"<body>{NAV}<div class='layout with-sidebar'><article>{ARTICLE}</article></div><div class=sidebar>The best of all the other things that you can read here are in this list.</div>",
        f"<body>{NAV}<article>{ARTICLE}</article><div id=comments><article class='comment'><p>I was the first to comment on this and I think that it is the best of all that I have read.</p></article></div>",
        f"<body>{NAV}<article>{ARTICLE}<p hidden>It is not to be seen by any of you who are here to read it, not now and not ever.</p><div style='color:red;display: none'>Nor is this one to be seen by you or by anyone.</div></article>",
        f"<head><title>x</title><meta charset=utf-8><body>{NAV}<article>{ARTICLE}</article>",
        f"<body>{NAV}<div class='cookie-notice'><p>We and all of our friends have put cookies on this page, and by going on you say that it is fine with you.</p></div><main>{ARTICLE}</main>",
        f"<body>{NAV}<article>{ARTICLE}</article><footer>© 2024 by the owner of this page and all that is on it</footer>",
        f"<body>{NAV}</b></span></i><article><a name=top><div>{ARTICLE}</div></article><form><p>Sign up for the news of the day and have it in your mail each morning.</p></form>",
        f'<body><p title="5" tall">{NAV}<article>{ARTICLE}</article>',
    ],
)
def test_no_article_is_lost_to_names_around_it(page):
    assert html_text.extract(page) == TEXT


def test_a_long_paragraph_may_have_a_copyright_sign():
    told = "The sign © is put before the name of the one who holds the right in a work, and it was first used in a law of the year 1909, which has been changed many times since then, as it is told here in all of its parts."
    assert html_text.extract(f"<body>{NAV}<p>{told}</p><footer>© me</footer>") == told


def test_a_page_in_another_language_keeps_its_text():
    told = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光果珍李柰菜重芥姜海咸河淡鳞潜羽翔"
    assert html_text.extract(f"<body>{NAV}<div><h2>千字文</h2><p>{told}</p><p>{told[::-1]}</p></div><footer>页脚</footer>") == f"千字文 {told} {told[::-1]}"


def test_many_open_and_stray_tags_take_linear_time():
    import time

    began = time.time()
    for part in ("<span>", "</span>", "<b></i>", "<div><b>", "<a href=x>", "<p x='", "<li><p>", "<!-", "&amp"):
        html_text.extract(part * 20000)
    assert time.time() - began < 20


class Twin(HTMLParser):
    """The same rules on well-formed pages, by another parser and with paths of containers for state."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.blocks, self.text, self.linked = [], [], "", 0

    def close_block(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append((text, self.linked, list(self.path)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK_TAGS:
            self.close_block()
        if tag not in html_text.VOID_TAGS:
            self.path.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK_TAGS:
            self.close_block()
        self.path.pop()

    def handle_data(self, data):
        if not any(t in html_text.SILENT_TAGS for t, _ in self.path):
            self.text += data
            self.linked += len(data) * any(t == "a" for t, _ in self.path)


def twin(page):
    parser = Twin()
    parser.feed(page)
    parser.close_block()
    labels, outer = [], []
    for text, linked, path in parser.blocks:
        tags = [t for t, _ in path]
        words = {w for _, a in path for w in re.split("[^a-z]+", f"{a.get('class', '')} {a.get('id', '')}")}
        stops = [w.lower() in html_text.STOP_WORDS for w in re.findall(r"[^\W\d_]+", text)]
        share, inside = sum(stops) / max(1, len(stops)), "article" in tags
        if {"nav", "footer", "aside", "form"} & set(tags) or words & (html_text.OUTER_WORDS | html_text.COMMENT_WORDS) or ("header" in tags and not inside):
            label = False
        elif linked > 0.33 * len(text):
            label = None if inside else False
        elif len(text) < 70:
            label = None
        elif share >= 0.3 or (len(text) >= 200 and share >= 0.15):
            label = True
        else:
            label = None if share >= 0.15 or inside or not linked else False
        labels.append((label, inside))
        outer.append(bool({"nav", "footer", "aside", "form"} & set(tags) or words & (html_text.OUTER_WORDS | html_text.COMMENT_WORDS) or ("header" in tags and not inside)))
    lends = [x is not None and (any(own for _, own in labels) or not off) for (x, _), off in zip(labels, outer)]
    out = []
    for i, (label, inside) in enumerate(labels):
        if label is None:
            left = next((j for j in range(i - 1, -1, -1) if lends[j]), None)
            right = next((j for j in range(i + 1, len(labels)) if lends[j]), None)
            near = [j for j in (left, right) if j is not None]
            if inside:
                own = [labels[j][0] for j in near if labels[j][1]]
                label = not own or any(own)
            elif not near:
                label = not any(x for _, x in labels)
            elif parser.blocks[i][2][-1][0] in ("h1", "h2") and right is not None:
                label = labels[right][0]
            elif len(near) == 1 or labels[left][0] == labels[right][0]:
                label = labels[near[0]][0]
            else:
                label = labels[left][0] if i - left < right - i else labels[right][0] if i - left > right - i else False
        if label:
            out.append(parser.blocks[i][0])
    return " ".join(out)


def test_made_pages_match_a_twin():
    rng = random.Random(7)
    plain = "cat dog mat river stone".split()
    stops = "the of and to in is".split()

    def words(n, share):
        return " ".join(rng.choice(stops if rng.random() < share else plain) for _ in range(n))

    def piece(depth):
        kind = rng.random()
        if kind < 0.1:
            return f"<h2>{words(3, 0.3)}</h2>"
        if kind < 0.5 or depth > 3:
            text = words(rng.choice([2, 5, 20, 60]), rng.choice([0.05, 0.2, 0.5]))
            return f"<p>{text} <a href='x'>{words(rng.choice([1, 8]), 0.4)}</a> &copy;</p>" if rng.random() < 0.3 else f"<p>{text}</p>"
        tag = rng.choice(["div", "section", "nav", "aside", "footer", "header", "div class='promo-box'", "ul id=comments", "div class='body'"])
        return f"<{tag}>{''.join(piece(depth + 1) for _ in range(rng.randint(1, 3)))}</{tag.split()[0]}>"

    for _ in range(400):
        main = f"<article><p>{words(90, 0.4)}</p>{''.join(piece(1) for _ in range(rng.randint(0, 3)))}<p>{words(400, 0.4)}</p></article>"
        page = f"<html><body>{''.join(piece(1) for _ in range(rng.randint(0, 3)))}{main if rng.random() < 0.7 else f'<p>{words(500, 0.4)}</p>'}{piece(1)}</body></html>"
        assert html_text.extract(page) == twin(page), page


def test_all_given_pages_match_the_twin_and_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tidy = lambda h: re.sub(r"<p><b>(.*?)<br>", r"<p><b>\1</b><br></p>", h)
    for r in html_text.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text == twin(tidy(r.html))
