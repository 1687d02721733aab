"""Aliases by automaton and budgets by heap, each against the plain form."""

import random
import re
import time

from pyspark.sql import functions as F

from tessera.operators import assemble as A
from tessera.operators import retrieve as E


def plain_alias(text, aliases):
    best = None
    for alias, slug, ordinal in aliases:
        a = (alias or "").lower()
        if a and text is not None and re.search(rf"(^|[^a-zA-Z0-9_]){re.escape(a)}($|[^a-zA-Z0-9_])", text.lower()):
            if best is None or (len(a), -ordinal) > best[0]:
                best = ((len(a), -ordinal), slug)
    return best and best[1]


def test_aliases_match_the_plain_search(spark):
    rng = random.Random(6)
    parts = ["ab", "b", "a.b", "c++", "x y", "été", "_z", "9"]
    aliases = [("".join(rng.choices(parts, k=rng.randint(1, 3))).strip(), f"s{i}", i) for i in range(60)] + [("", "none", 60), (None, "no", 61), ("AB", "later", 99)]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))).replace("  ", rng.choice([" ", ", ", ""])) for _ in range(300)] + [None, "", "AB", "xabx", "été!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("size", F.lit("own"))
    listed = spark.createDataFrame(aliases, "alias string, slug string, ordinal int")
    for part_rows in (1000, 7):
        out = E.detect_alias(rows, "text", listed, "i", part_rows)
        assert out.columns == ["i", "text", "size", "slug"]
        got = {r.i: r.slug for r in out.collect()}
        assert got == {i: plain_alias(t, aliases) for i, t in enumerate(texts)}
    assert E.detect_alias(rows, "text", listed.limit(0), "i").filter("slug IS NOT NULL").count() == 0


def test_a_hundred_thousand_aliases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = [r.w for r in docs.select(F.explode(F.split(F.lower("text"), r"\W+")).alias("w")).filter("length(w) > 3").distinct().orderBy("w").limit(3000).collect()]
    aliases = [(w, f"w{i}", i) for i, w in enumerate(words)] + [(f"{words[i % 3000]} {words[i * 7 % 3000]}", f"p{i}", 3000 + i) for i in range(97_000)]
    listed = spark.createDataFrame(aliases, "alias string, slug string, ordinal int")
    out = E.detect_alias(docs, "text", listed, "doc_id")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.slug for r in out.collect()}
    for r in docs.filter("doc_id % 40 = 0").collect():
        assert got[r.doc_id] == plain_alias(r.text, [x for x in aliases if x[0] in r.text.lower()])


def plain_budget(rows, most, compress, protected):
    held, refused = [], []
    for row in rows:
        if row["tokens"] > most:
            refused.append((row["ts"], "entry exceeds budget"))
            continue
        while sum(h["tokens"] for h in held) + row["tokens"] > most:
            free = [h for h in held if h["role"] not in protected]
            found = [h for h in held if h["role"] == "retrieval"]
            if free:
                gone = [min(free, key=lambda h: (h["priority"], h["ts"]))]
            elif compress is not None and len(found) > sum(h["priority"] == 2.0 for h in found):
                gone, said = found, compress([h["content"] for h in found])
                held.append(found[-1] | {"content": said, "tokens": len(said.split()), "priority": 2.0})
            else:
                refused.append((row["ts"], "budget exhausted"))
                break
            held = [h for h in held if not any(h is g for g in gone)]
        else:
            held.append(row)
    return sorted([(h["ts"], h["tokens"], None) for h in held] + [(t, None, e) for t, e in refused])


def test_budgets_match_the_plain_fold(spark):
    rng = random.Random(2)
    schema = "session_id int, role string, content string, tokens int, priority double, ts int"
    names = schema.replace(",", "").split()[::2]
    short = lambda texts: " ".join(t.split()[0] for t in texts[-3:])
    rows = []
    for session in range(30):
        for ts in range(40):
            n = rng.choice([1, 2, 5, 9, 30])
            rows.append((session, rng.choice(["system", "user", "retrieval", "retrieval", "tool"]) if rng.random() < 0.9 else "system", " ".join("w" * n), n, float(rng.choice([0, 1, 2, 3])), ts))
    df = spark.createDataFrame(rows, schema)
    for compress, protected in ((None, ("system",)), (short, ("system", "retrieval")), (short, ("system", "retrieval", "user", "tool"))):
        got = {}
        for r in A.fit_budget(df, 25, compress=compress, protected=protected).collect():
            got.setdefault(r.session_id, []).append((r.ts, None if r.error else r.tokens, r.error))
        for session in range(30):
            own = [dict(zip(names, r)) for r in rows if r[0] == session]
            assert sorted(got.get(session, []), key=str) == sorted(plain_budget(own, 25, compress, protected), key=str)


def test_a_session_of_a_hundred_thousand_entries(spark):
    df = spark.range(100_000).select(F.lit(1).alias("session_id"), F.lit("user").alias("role"), F.lit("a b").alias("content"), F.lit(2).alias("tokens"), (F.col("id") % 7).cast("double").alias("priority"), F.col("id").alias("ts"))
    began = time.time()
    rows = A.fit_budget(df, 50_000).collect()
    assert len(rows) == 25_000 and time.time() - began < 10
