"""Column functions over text: cleaning, counting, splitting.

All are native expressions but one: templates nested deeper than three levels are taken out by a scanner in Arrow
batches, which other texts do not enter. Every function's time grows with the length of a text, whatever is in it:
patterns look for an end only where one is to come (``closed``), and repeated groups are possessive, so that Java
walks them in a loop and does not go down one call each time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Prefixes of clerical lines, of image residue and of notices.
CLERICAL_PREFIXES = ("|", "{{", "}}", "Category:")
IMAGE_RESIDUE = r"\d+px\||thumb\||left\||right\||center\||border\|"
NOTICE_PREFIXES = ("this article is about", "you may be looking for", "warning:", "spoiler:")

#: White space as patterns know it.
BLANKS = " \t\n\x0b\x0c\r"

#: Stands for a line that :func:`drop_image_residue` takes out; a text's own are dropped.
_MARK = "\u0001"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Whitespace words in order; none in an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Number of whitespace words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct lower-case whitespace words."""
    return F.array_distinct(words(F.lower(text)))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(BLANKS))


def closed(text: Column, end: str, body) -> Column:
    """``body`` of a text up to the last ``end`` in it, and the rest as it is.

    What begins after the last end cannot be closed: a pattern that looked for one would read on to the end of the text,
    again and again.
    """

    def cut(t: Column) -> Column:
        tail = F.substring_index(t, end, -1)
        head = F.left(t, F.char_length(t) - F.char_length(tail))
        return F.when(F.contains(t, F.lit(end)), F.concat(body(head), tail)).otherwise(t)

    return let(text, cut)


def closed_by(text: Column, end: str, body) -> Column:
    """The same for a pattern of an end."""

    def cut(t: Column) -> Column:
        tail = F.element_at(F.split(t, end), -1)
        head = F.left(t, F.char_length(t) - F.char_length(tail))
        return F.when(F.rlike(t, F.lit(end)), F.concat(body(head), tail)).otherwise(t)

    return let(text, cut)


def _without(text: Column, begin: str, end: str, put: str = "") -> Column:
    """Without elements from ``begin`` to the next ``end``, patterns both."""
    return closed_by(text, f"(?i){end}", lambda x: F.regexp_replace(x, f"(?is){begin}.*?{end}", put))


def strip_refs(text: Column) -> Column:
    """Without ``<ref>`` blocks, self-closed refs and HTML comments; a tag has no ``<`` in it."""
    out = F.regexp_replace(text, r"(?i)<ref[^<>/]*+/>", "")
    out = _without(out, r"<ref[^<>]*+>", "</ref>")
    return closed(out, "-->", lambda x: F.regexp_replace(x, r"(?s)<!--.*?-->", ""))


def drop_clerical(text: Column, prefixes: tuple[str, ...] = CLERICAL_PREFIXES) -> Column:
    """Without lines that start, after white space, with a clerical prefix; blank lines stay."""

    clerical = r"^\s*+(?:" + "|".join(rf"\Q{prefix}\E" for prefix in prefixes) + ")"
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(clerical))), "\n")


def drop_image_residue(text: Column) -> Column:
    """Without lines that are left over from image captions; white space before such a line goes with it, up to the end of a line."""
    residue = rf"^\s*+(?:{IMAGE_RESIDUE})"
    clean = F.replace(text, F.lit(_MARK), F.lit(""))
    marked = F.array_join(F.transform(F.split(clean, "\n"), lambda x: F.when(F.rlike(x, F.lit(residue)), _MARK).otherwise(x)), "\n")
    # From the marks backwards, so that only white space that leads to one is read.
    back = rf"{_MARK}\s*+\z|{_MARK}\s*(?=\n)"
    return let(marked, lambda m: F.when(F.contains(m, F.lit(_MARK)), F.reverse(F.regexp_replace(F.reverse(m), back, ""))).otherwise(m))


def normalise_ws(text: Column) -> Column:
    """Runs of blanks and tabs as one blank, three or more newlines as two, trimmed."""
    out = F.regexp_replace(text, r"[ \t]{2,}+|\t", " ")  # single blanks stay as they are
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def html_to_text(html: Column) -> Column:
    """Visible text of HTML: scripts, styles, navigation and comments go, then tags; the usual entities are decoded."""
    out = html
    for tag in ("script", "style", "nav"):  # scripts first, so that one within navigation does not end it
        out = _without(out, rf"<{tag}\b", rf"</{tag}\s*+>", " ")
    out = closed(out, "-->", lambda x: F.regexp_replace(x, r"(?s)<!--.*?-->", " "))
    out = closed(out, ">", lambda x: F.regexp_replace(x, r"<[^>]*+>", " "))
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_templates(text: str) -> str:
    """``text`` without templates, however deep, in one pass: what lies open is a stack of places in what is kept."""
    kept, open_, at = [], [], 0
    for found in re.finditer(r"\{\{|\}\}", text):
        kept.append(text[at : found.start()])
        at = found.end()
        if found[0] == "{{":
            open_.append(len(kept))
            kept.append("{{")
        elif open_:
            del kept[open_.pop() :]
        else:
            kept.append("}}")
    return "".join(kept) + text[at:]


@F.arrow_udf(StringType())
def _scanned(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else without_templates(t) for t in texts.to_pylist()], pa.string())


def drop_templates(text: Column) -> Column:
    """Without ``{{ }}`` templates, however deep; an opening without its end stays, as does an end without an opening.

    Those within which there are no braces go first, level by level; texts that still hold both marks go on to a scanner.
    """
    for _ in range(3):
        text = F.regexp_replace(text, r"\{\{[^{}]*+\}\}", "")
    deep = F.contains(text, F.lit("{{")) & F.contains(text, F.lit("}}"))
    return F.coalesce(_scanned(F.when(deep, text)), text)


def wiki_to_text(text: Column) -> Column:
    """Plain text of wiki markup: refs, templates, file and category links go; labels of links stay.

    A web address ends at white space or at an opening bracket.
    """
    out = drop_templates(strip_refs(text))
    out = F.regexp_replace(out, r"(?i)\[\[(?:File|Image|Category):[^\[\]]*+(?:\[\[[^\[\]]*+\]\][^\[\]]*+)*+\]\]", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    out = closed(out, "]", lambda x: F.regexp_replace(x, r"\[https?://[^\s\[]++\s++([^\]]*+)\]", "$1"))
    out = F.regexp_replace(out, r"'{2,}", "")
    out = closed(out, ">", lambda x: F.regexp_replace(x, r"<[^>]++>", ""))
    return normalise_ws(drop_image_residue(drop_clerical(out)))


def lead(text: Column, first_chars: int = 4000) -> Column:
    """From the first bold marker to the first heading; without a marker what follows the last ``}}`` of the first characters."""
    at = F.instr(text, "'''")
    head = F.substr(text, F.lit(1), F.lit(first_chars))
    start = F.when(at > 0, F.substr(text, at)).otherwise(F.element_at(F.split(head, r"\}\}"), -1))
    return strip(F.get(F.split(start, r"\n==", 2), F.lit(0)))


def collapse_paragraph(text: Column, max_words: int = 400) -> Column:
    """One paragraph: notices go, lines are joined, residue of punctuation is mended, cut at ``max_words`` words."""

    def notice(line: Column) -> Column:
        found = line == ""
        for prefix in NOTICE_PREFIXES:
            found = found | F.startswith(F.lower(line), F.lit(prefix))
        return found

    lines = F.transform(F.split(text, "\n"), strip)
    joined = F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~notice(x)), " "), r"\s+", " ")
    for residue, mended in ((r"\s+,", ","), (r",\s*,+", ","), (r"\(\s*,?\s*\)", ""), (r"\s+\.", "."), (r"\s{2,}", " ")):
        joined = F.regexp_replace(joined, residue, mended)
    return let(words(joined), lambda w: F.when(F.size(w) <= max_words, joined).otherwise(F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, max_words), " "), "[,.;:]+$", ""), F.lit("…"))))


def slugify(text: Column) -> Column:
    """Lower case with hyphens for all but letters and digits; ``section`` when nothing is left."""
    out = F.lower(F.trim(F.regexp_replace(text, r"[\W_]++", "-"), F.lit("-")))
    return F.coalesce(F.nullif(out, F.lit("")), F.when(text.isNotNull(), F.lit("section")))


def sentences(text: Column) -> Column:
    """Sentences of a text whose newlines are blanks: cut after ``.!?`` before a capital, a quote or a parenthesis."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s{2,}+|[^\S ]", " ")), r"(?<=[.!?])\s+(?=[A-Z\"'(])"), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct tokens; 1 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def content_hash(text: Column) -> Column:
    """SHA-256 of a text."""
    return F.sha2(text, 256)
