"""Texts that are long and odd: every text function ends in time and with the right result."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk

MEGA = 1_000_000
FUNCTIONS = (T.strip_refs, T.drop_clerical, T.drop_image_residue, T.normalise_ws, T.html_to_text, T.drop_templates, T.wiki_to_text, T.lead, T.collapse_paragraph, T.slugify)
ODD = {
    "numbers": "0,1," * (MEGA // 4),
    "dashes": "-" * MEGA,
    "stops": ". " * (MEGA // 2),
    "emoji": "\U0001f600" * (MEGA // 4),
    "mixed": "!?;:,.-'\"()*&" * (MEGA // 13),
    "letters": "a" * MEGA,
    "newlines": "\n" * MEGA,
    "blanks": " \n" * (MEGA // 2) + "x",
    "residue": "thumb|" * (MEGA // 6),
    "file link": "[[File:x" + "[[a]]" * (MEGA // 5) + "]]",
}
OPEN = {k: k * (MEGA // len(k)) for k in ("<!--", "<", "[[", "{{", "<ref ", "<ref>", "<script>", "[http://a b", "[[File:", "</script ", "'''", "[http://")}


def run(spark, texts, function):
    """The result of each text, and the seconds that took."""
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "k string, t string").repartition(4)
    began = time.time()
    rows = df.select("k", function(F.col("t")).alias("out")).collect()
    return dict(map(tuple, rows)), time.time() - began


@pytest.mark.parametrize("function", FUNCTIONS, ids=lambda f: f.__name__)
def test_in_time(spark, function):
    got, took = run(spark, ODD | OPEN, function)
    assert took < 60 and len(got) == len(ODD | OPEN) and all(v is not None for v in got.values())  # 22 texts of a megabyte


def test_results(spark):
    got, _ = run(spark, ODD | OPEN, T.wiki_to_text)
    for same in ("numbers", "dashes", "emoji", "mixed", "letters", "<!--", "<", "[[", "[[File:"):
        assert got[same] == (ODD | OPEN)[same], same
    assert got["stops"] == ODD["stops"].strip() and got["newlines"] == "" and got["blanks"] == "x"
    assert got["residue"] == got["file link"] == got["{{"] == got["'''"] == ""  # a line of openings is clerical
    got, _ = run(spark, ODD | OPEN, T.html_to_text)
    for same in ("numbers", "dashes", "emoji", "mixed", "letters", "<!--", "<", "[[", "{{"):
        assert got[same] == (ODD | OPEN)[same], same
    assert got["<script>"].strip() == "" and got["<ref>"] == ""


def test_ten_megabytes_of_what_is_never_closed(spark):
    texts = {k: k * (10 * MEGA // len(k)) for k in ("<!--", "<", "[[", "{{")}
    for function in (T.strip_refs, T.wiki_to_text, T.html_to_text, T.drop_templates):
        for name, text in texts.items():
            _, took = run(spark, {name: text}, function)
            assert took < 10, (function.__name__, name, took)
    nested = "{{" * MEGA + "x" + "}}" * (MEGA - 1) + "y"
    out, took = run(spark, {"n": nested}, T.drop_templates)
    assert out["n"] == "{{y" and took < 10


def plainly(text, patterns):
    for pattern, put in patterns:
        text = re.sub(pattern, put, text)
    return text


CASES = [
    "a<!-- b -->c<!-- d", "<!-- a <!-- b --> c --> d", "<ref name=\"x\">a</ref>b<REF/>c<ref>d", "a <ref>b\nc</ref > d</ref>e", "x > y < z > w", "<b>x</b", "a<>b", "",
    "one\n\n \nthumb|x\ntwo", "thumb|x", " \n\n thumb|x|y\n\nleft|center| z", "a\n 120px|b\n\n", "a thumb|b", "\n\nright|", "[http://a.b c] d [https://x y", "[http://a b\nc]",
    "<script>a</script >b<SCRIPT x>c</script>d<script>e", "<nav><script>x</nav></script></nav>y",
]


def test_same_as_the_plain_patterns(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    t = F.col("t")
    rows = df.select("t", T.strip_refs(t).alias("refs"), T.drop_image_residue(t).alias("residue"), T.html_to_text(t).alias("html")).collect()
    for r in rows:
        assert r.refs == plainly(r.t, [(r"(?is)<ref[^>/]*/>", ""), (r"(?is)<ref[^>]*>.*?</ref>", ""), (r"(?s)<!--.*?-->", "")]), r.t
        assert r.residue == plainly(r.t, [(r"(?m)^\s*(?:\d+px\||thumb\||left\||right\||center\||border\|)+[^\n]*$", "")]), r.t
        html = plainly(r.t, [(rf"(?is)<{x}\b.*?</{x}\s*>", " ") for x in ("script", "style", "nav")] + [(r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "), (r"\s+", " ")])
        assert r.html == html.strip(" "), r.t


def test_templates_in_one_pass():
    assert T.without_templates("a{{b{{c}}d}}e") == "ae"
    assert T.without_templates("a}}b{{c{{d}}e") == "a}}b{{ce"
    assert T.without_templates("{{{x}}}") == "}"


def test_sections_of_a_long_text(spark):
    df = spark.createDataFrame([(1, "\n" * MEGA + "== A ==\n" + "x " * MEGA)], "doc_id int, t string")
    assert chunk.sections(df, "t").count() >= 1
