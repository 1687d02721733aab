"""Texts of a megabyte of one kind: no operator falls over them, and each gives its right result in time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_text, line_dedup, pii, quality

MEGA = 1_000_000
ODD = {
    "numbers": "0,1," * (MEGA // 4),
    "digits": "7" * MEGA,
    "dashes": "-" * MEGA,
    "stops": ". " * (MEGA // 2),
    "emoji": "\U0001f600" * (MEGA // 4),
    "mixed": "!?;:,.-'\"()*&" * (MEGA // 13),
    "letters": "a" * MEGA,
    "capitals": "A" * MEGA,
    "comments": "<!--" * (MEGA // 4),
    "braces": "{{" * (MEGA // 2),
    "addresses": "a@b." * (MEGA // 4),
    "plus": "+1" * (MEGA // 2),
}
ITEM = "Anna has 12 apples and 5 kg of pears, while Ben has 12 apples too"


@pytest.fixture(scope="module")
def odd(spark):
    rows = list(enumerate(ODD.values()))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(4)


def timed(df):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < 60
    return rows


def test_words_of_templates(spark, odd):
    words = {r.doc_id: r for r in timed(odd.select("doc_id", F.size(decontaminate.marked_words(F.col("text"))).alias("n"), F.get(decontaminate.marked_words(F.col("text"), True), F.lit(0)).alias("w")))}
    want = {"numbers": 1, "digits": 1, "letters": 1, "capitals": 1}
    for i, (name, text) in enumerate(ODD.items()):
        assert words[i].n == want.get(name, 0) or name in ("addresses", "plus"), name
    assert words[0].w == ODD["numbers"].rstrip(",") + "\u0002"


def test_contaminated(spark, odd):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    both = odd.withColumn("text", F.concat("text", F.lit(f" {ITEM} "), "text"))
    assert sorted(r.doc_id for r in timed(decontaminate.contaminated(both, items))) == list(range(len(ODD)))
    assert timed(decontaminate.contaminated(odd, items)) == []
    assert len(timed(decontaminate.clean(odd, items).select("doc_id"))) == len(ODD)


def test_a_document_that_holds_every_item(spark):
    rng = random.Random(8)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(14)) + f" {i} kg") for i in range(1500)]
    docs = [(1, "\n".join(t for _, t in items)), (2, items[7][1])]
    began = time.time()
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [*((1, i) for i in range(1500)), (2, 7)]
    assert time.time() - began < 60


def test_pii(spark, odd):
    more = odd.withColumn("text", F.concat("text", F.lit(" b@b.c secretword ")))  # the word gives b@b.c away
    others = more.sparkSession.range(200).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    rows = {r.doc_id: r for r in timed(pii.find_pii(more.union(others))) if r.doc_id < 100}
    assert all("secretword" in [s.value for s in r.term] for r in rows.values())
    for i, text in enumerate(ODD.values()):
        assert [s.start for s in rows[i].email] == [m.start() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", f"{text if '@' in text else ' ' * len(text)} b@b.c ")]


def test_quality_and_lines(spark, odd):
    assert {r.doc_id: r.n_words for r in timed(quality.judge(odd))} == {i: len(t.split()) for i, t in enumerate(ODD.values())}
    assert [r.n_dropped for r in timed(line_dedup.dedup_lines(odd))] == [0] * len(ODD)


def test_html(spark, odd):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<html><body><p>"), "text", F.lit("</p></body></html>")).alias("html"))
    rows = {r.page_id: r.text for r in timed(html_text.extract_pages(pages))}
    assert len(rows) == len(ODD)
