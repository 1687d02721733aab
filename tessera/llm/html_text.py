"""HTML extraction by two passes of block rules.

A page is cut into blocks at block tags. Containers whose names or states tell that they surround an article are
judged by what they hold: one that holds nearly all of a page's plain text, or most of it and an article, surrounds
nothing. A name is one vote: where a word for such a thing stands beside others that are none (market-share,
entry-header), the container's links, length, stop words and headings decide. The first pass classes each block by its containers, link density, length and stop-word density: boilerplate,
text, or undecided, as where a block is short. In the second pass an undecided block takes the label of the nearest
decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import map_batches

#: Stop words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
        "der die das und in zu den von ist des sich mit dem nicht ein eine als auch es an auf für im so dass werden aus er hat sie nach bei um am sind noch wie einem über einen zum war haben nur oder aber vor bis mehr durch man "
        "le la les de des du un une et à en est que qui dans pour pas sur au par plus ne se ce il elle sont avec son sa ses ou mais nous vous leur aux cette "
        "el los las del y al lo una uno por con para su sus como pero más este esta o si ya fue ser son entre cuando muy sin sobre también me hasta hay donde"
    ).split()
)
#: Tags that end a block; tags whose contents are no text; tags and words in class, id or role of what surrounds an article.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center col dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template svg annotation annotation-xml iframe textarea title head select option canvas audio video".split())
OUTER_TAGS = frozenset("nav footer header aside form menu dialog".split())
OUTER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe taboola toolbar widget".split()
)
#: Words that go with those in names of what surrounds an article; words that say what a header heads.
FRAME_WORDS = frozenset(
    "area articles bar block body bottom box btn btns button buttons center col column container content desktop entry fixed form global group icon icons inner item items js left link links list lists main me message mobile our outer overlay panel post posts right row section signup site slot sticky stories text this top unit us wrap wrapper your zone".split()
)
HEADED_WORDS = frozenset("article chapter content entry page post section story title".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_TAGS = frozenset("head meta link base title style script noscript template".split())
#: The open blocks that the start of a block ends; of all others it ends an open paragraph.
ENDED = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}

#: Blocks of fewer characters are short; link density of boilerplate; stop-word densities of text, for long and other blocks.
SHORT, LONG, LINKS, STOP_HIGH, STOP_LOW = 70, 200, 0.33, 0.30, 0.15
#: A page of lower stop-word density is in a language whose stop words are not known; there length and links decide.
STOP_KNOWN = 0.12
#: Shares of a page's plain text from which a container with an article, and one without, surrounds nothing.
MOST, NEARLY_ALL = 0.5, 0.9

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^<>]*\Z", re.S
)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_RIGHTS = re.compile(r"\W*(?:copyright\W*)?(?:©|\(c\))(.{0,30}?\b(?:19|20)\d\d\b)?", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Region:
    """A container that may surround an article, in one around it or none (-1)."""

    around: int
    kind: str  # hidden, comments, tag, words or mixed
    inside: bool = False
    plain: int = 0
    linked: int = 0
    stops: int = 0
    words: int = 0
    article: bool = False
    titled: bool = False
    closed: bool = False
    outer: bool = False


@dataclass
class Block:
    """A stretch of text between block tags."""

    region: int
    inside: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    pressed: int = 0
    text: str = ""
    outer: bool = False
    article: bool = False
    heading: bool = False


def _kind(tag: str, raw: str, inside: bool) -> str:
    """What kind of region a tag opens, or none."""
    attributes = {}
    for name, value in _ATTRIBUTE.findall(raw) if raw else ():
        attributes.setdefault(name.lower(), html.unescape(value).strip("\"'"))
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(attributes.get("style", "")):
        return "hidden" if tag not in ("html", "body") else ""
    names = [{w for w in _SPLIT.split(name) if w} for a in ("class", "id", "role", "aria-label") if a in attributes for name in attributes[a].lower().split()]
    words = set().union(*names)
    if tag in ("html", "body", "main"):
        return ""
    if words & COMMENT_WORDS:
        return "comments"
    if tag == "article":
        return ""
    if tag in OUTER_TAGS and not (tag == "header" and inside):
        return "words" if tag == "form" else "tag"
    told = ""
    for name in names:
        own = name & OUTER_WORDS
        if own and (own == {"header"} and name & HEADED_WORDS or name - OUTER_WORDS - FRAME_WORDS):
            told = told or "mixed"
        elif own:
            told = "words"
    return told


def _cut(page: str) -> tuple[list[Block], list[Region]]:
    """The page's blocks that hold text, in order, and its regions, those around others first."""
    found: list[Block] = []
    regions: list[Region] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, silent, region, link
    places: dict[str, list[int]] = defaultdict(list)  # of each open tag in the stack
    opened: list[int] = []  # places of open blocks
    silent = link = inside = article = press = 0
    region = -1
    current = Block(-1, False)

    def close() -> None:
        nonlocal current
        text = " ".join("".join(current.parts).split())
        if text:
            current.text = text
            found.append(current)
        current = Block(region, inside > 0, article=article > 0)

    def say(raw: str) -> None:
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            current.parts.append(text)
            if link:
                current.linked += len(text)
            if press:
                current.pressed += len(text)

    def leave(k: int, by: str = "") -> None:
        """Close all that was opened at place ``k`` of the stack and since."""
        nonlocal silent, link, inside, article, press, region
        while len(stack) > k:
            tag, was_silent, own, was_link = stack.pop()
            places[tag].pop()
            if opened and opened[-1] == len(stack):
                opened.pop()
            silent -= was_silent
            link -= was_link
            inside -= tag in ("article", "main")
            article -= tag == "article"
            press -= tag == "button"
            if own >= 0:
                regions[own].closed = len(stack) == k and tag == by
                region = regions[own].around
        current.region, current.inside, current.article = region, inside > 0, article > 0

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            continue
        tag, raw, block = name.lower(), token[3] or token[6] or "", name.lower() in BLOCK_TAGS
        if token[1] or token[4]:
            if block:
                close()
            # An end tag ends its innermost open element; that of no block ends nothing beyond a block.
            if places[tag] and (block or tag in SILENT_TAGS or not opened or places[tag][-1] > opened[-1]):
                leave(places[tag][-1], tag)
            continue
        if places["head"] and tag not in HEAD_TAGS:
            close()
            leave(places["head"][-1])
        if block:
            close()
            while opened and stack[opened[-1]][0] in ENDED.get(tag, ("p",)):
                leave(opened[-1])
        elif tag == "a" and places["a"] and (not opened or places["a"][-1] > opened[-1]):
            leave(places["a"][-1])
        if tag in VOID_TAGS or raw.rstrip().endswith("/"):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        kind, own = _kind(tag, raw, inside > 0), -1
        if kind:
            if not block:  # a region's text is in blocks of its own
                close()
            own = len(regions)
            regions.append(Region(region, kind, inside > 0))
            region = own
        if block:
            opened.append(len(stack))
        places[tag].append(len(stack))
        is_link = tag == "a" and bool(_HREF.search(raw))  # others are anchors, which hold nothing
        stack.append((tag, tag in SILENT_TAGS, own, is_link))
        silent += tag in SILENT_TAGS
        link += is_link
        inside += tag in ("article", "main")
        article += tag == "article"
        press += tag == "button"
        if tag in ("article", "main") and region >= 0 and kind != "comments":
            regions[region].article = True
        current.region, current.inside, current.article = region, inside > 0, article > 0
        current.heading |= tag in HEADINGS
    close()
    return found, regions


def blocks(page: str) -> list[Block]:
    """The page's blocks that hold text, in order, with what their containers say of them."""
    found, regions = _cut(page)
    off = []  # whether a region is hidden, or of comments, or in such a one
    for r in regions:
        off.append(r.kind in ("hidden", "comments") or (r.around >= 0 and off[r.around]))
    total = stops = words = 0
    for b in found:
        if b.region < 0 or not off[b.region]:
            linked = min(len(b.text), b.linked)
            said = _stop_words(b.text)
            total += len(b.text) - linked
            if linked <= LINKS * len(b.text):
                stops, words = stops + said[0], words + said[1]
            if b.region >= 0:
                own = regions[b.region]
                own.plain, own.linked, own.stops, own.words = own.plain + len(b.text) - linked, own.linked + linked, own.stops + said[0], own.words + said[1]
                own.titled |= b.heading
    known = stops >= STOP_KNOWN * words
    for i in range(len(regions) - 1, -1, -1):
        r = regions[i]
        if r.around >= 0:
            up = regions[r.around]
            up.plain, up.linked, up.stops, up.words = up.plain + r.plain, up.linked + r.linked, up.stops + r.stops, up.words + r.words
            up.article |= r.article and not off[i]
            up.titled |= r.titled
    for i, r in enumerate(regions):
        spared = r.plain > MOST * total if r.article else r.plain > NEARLY_ALL * total and (r.kind in ("words", "mixed") or not r.closed)
        if r.kind == "mixed" and r.linked <= LINKS * (r.plain + r.linked):
            spared |= r.inside or r.titled or (r.plain >= SHORT and (not known or r.stops >= STOP_LOW * r.words))
        r.outer = off[i] or not spared or (r.around >= 0 and regions[r.around].outer)
    for b in found:
        b.outer = b.region >= 0 and regions[b.region].outer
    return found


def _stop_words(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _first_pass(block: Block, known: bool) -> bool | None:
    """Text, boilerplate, or undecided; ``known`` is whether the page's stop words are."""
    size = len(block.text)
    if block.outer or block.pressed > LINKS * size:
        return False
    stops, words = _stop_words(block.text)
    density = stops / max(1, words)
    rights = _RIGHTS.match(block.text) if size < LONG else None
    if rights and (rights[1] or words <= 12 or density < STOP_LOW):  # a sign, a year, a name
        return False
    if block.linked > LINKS * size:  # lists of links within an article are its own
        return None if block.article else False
    if size < SHORT:
        return None
    if not known:
        return True
    if density >= STOP_HIGH or (size >= LONG and density >= STOP_LOW):
        return True
    return None if density >= STOP_LOW or block.inside or not block.linked else False


def extract(page: str | None) -> str:
    """The main text of a page: its text blocks, joined by single spaces."""
    found = blocks(page or "")
    counts = [_stop_words(b.text) for b in found if not b.outer and b.linked <= LINKS * len(b.text)]
    known = sum(stops for stops, _ in counts) >= STOP_KNOWN * sum(words for _, words in counts)
    first = [_first_pass(b, known) for b in found]
    # Blocks within an article or main element are decided against by rule only; the others keep to them. Where there
    # is none, what surrounds the page lends its label to nothing.
    has_inside = any(b.inside for b in found)
    lends = [x is not None and (has_inside or not b.outer) for x, b in zip(first, found)]
    before: list[tuple[bool, int] | None] = []
    last: tuple[bool, int] | None = None
    for i, label in enumerate(first):
        if lends[i]:
            last = (label, i)
        before.append(last)
    labels, after = [False] * len(found), None
    for i in range(len(found) - 1, -1, -1):
        label = first[i]
        if lends[i]:
            after = (label, i)
        if label is None:
            near = [x for x in (before[i], after) if x is not None]
            if found[i].inside:
                inner = [x for x in near if found[x[1]].inside]
                label = any(x[0] for x in inner) or not inner
            elif not near:
                label = not has_inside
            elif found[i].heading and after is not None:  # a heading belongs to what follows
                label = after[0]
            elif len(near) == 2 and near[0][0] != near[1][0]:
                label = near[0][0] if i - near[0][1] < near[1][1] - i else near[1][0] if i - near[0][1] > near[1][1] - i else False
            else:
                label = near[0][0]
        labels[i] = label
    if not any(labels):  # a page of short blocks only
        labels = [x is None and b.linked <= LINKS * len(b.text) for x, b in zip(first, found)]
    return " ".join(b.text for b, label in zip(found, labels) if label)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = pa.array([extract(x.as_py()) for x in part.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], texts], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` row for row.

    The whole page is read. A null or empty page, or one without text, gives an empty text; null ids and urls and
    repeated rows are returned as they come; other columns are not looked at.
    """
    rows = pages.select(F.col(html_col).cast("string").alias("html"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    out = map_batches(rows, _batches, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
