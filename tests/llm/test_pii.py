import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    text = text or ""
    out = {k: [] for k in pii.KINDS}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def texts():
    rng = random.Random(6)
    bits = ["a.b@c.d", "x@y", "q_w@e-r.t.", "@", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (974) 555-1257", "+12", "é", " ", "\n", "12345678901234567890", "a@b.c_x@y.z", "7"]
    out = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(300)]
    return [*out, None, "", "a" * 60000, "1" * 60000, "1.1" * 9000, "a." * 9000 + "@b" + ".c" * 9000, "+1" + "(" * 30000]


def test_base_spans_match_plain_rules(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = df.select("doc_id", *[pii.base_spans(F.col("text"), k).alias(k) for k in pii.KINDS]).collect()
    for r in got:
        want = plain(texts()[r.doc_id])
        for k in pii.KINDS:
            assert [(s.start, s.stop) for s in r[k] or []] == want[k], (r.doc_id, k, texts()[r.doc_id])


def test_disclosing_terms(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choices("one two three four five six seven to".split(), k=n))
    # The name stands far from the address.
    rows = [(i, f"Ziggurat é mail mail {filler(150 + i)} to sam@corp.example.org {filler(i + 3)}") for i in range(5)]
    rows += [(50 + i, f"Mr Obelisk7 {filler(20)} bo@corp.example.org {i}") for i in range(12)]
    rows += [(100 + i, f"{filler(12)} ziggurats {filler(3)} mail {i}") for i in range(90)]
    rows += [(200, "the ziggurat again, alone; mr obelisk7"), (201, None), (None, ""), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "z", "k", 1) for r in rows], "doc_id long, text string, term string, KEY string, spans int")
    got = pii.find_pii(docs).withColumn("spans", pii.written((*pii.KINDS, "term")))
    out = got.collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [s.value for s in by[200].term] == ["ziggurat", "mr", "obelisk7"] and by[200].spans == "term:4:12,term:27:29,term:30:38"
    assert not by[100].term and {s.value for s in by[0].term} == {"Ziggurat", "é"} and by[0].spans.startswith("email:")
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[200] == "the <TERM> again, alone;  " and texts[50].startswith("  ") and texts[0].startswith("<NAME>  mail mail")
    assert clean.filter("text like '%@%'").count() == 0 and clean.filter("text is null").count() == 1


def test_term_thresholds_match_brute_force(spark):
    import math
    from collections import defaultdict

    rng = random.Random(5)
    people = [f"p{i}@x.org" for i in range(6)]
    docs = []
    for i in range(150):
        who = rng.sample(people, rng.choice([0, 1, 1, 2]))
        words = rng.choices([f"w{k}" for k in range(25)], k=6) + [f"n{p[1]}" for p in who if rng.random() < 0.8]
        docs.append((i, " ".join([*words, *who, str(i)])))
    of_term, of_entity = defaultdict(set), defaultdict(set)
    for i, t in docs:
        for w in re.findall(r"[a-z0-9]+", t):
            of_term[w].add(i)
        for p in re.findall(r"p[0-9]@x\.org", t):
            of_entity[p].add(i)
    want = {}
    for w, ws in of_term.items():
        for es in of_entity.values():
            both = len(ws & es)
            share = both / len(ws)
            if both >= 3 and share >= 0.5 and math.log2(share / (len(es) / len(docs))) >= 2:
                want[w] = max(want.get(w, 0), share)
    found = spark.createDataFrame(docs, "doc_id long, text string")
    got = pii.disclosures(found, pii.materialise(pii.scanned(found)), bits=2)
    assert {r.term: r.given for r in got.collect()} == want and len(want) > 5


def test_running_and_replaced(spark):
    rng = random.Random(3)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 1000)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<bigint>").select("i", pii.running(F.col("v"), pii.added).alias("s"), pii.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    from itertools import accumulate

    for r in got:
        assert r.s == list(accumulate(rows[r.i])) and r.m == list(accumulate(rows[r.i], max))
    texts, spans = [], []
    for n in (0, 5, 1024, 1025, 4000):
        text = "".join(rng.choices("abé\n😀", k=n))
        own = sorted((a, min(n, a + rng.randint(1, 1500)), rng.choice(["<X>", ""])) for a in rng.sample(range(n), min(n, 6)))
        texts.append(text)
        spans.append(own)
    df = spark.createDataFrame(list(zip(range(9), texts, spans)), "i int, t string, s array<struct<start:bigint,stop:bigint,by:string>>")
    for r in df.select("i", pii.replaced(F.col("t"), F.col("s")).alias("out")).collect():
        want, at = "", 0
        for a, b, by in spans[r.i]:
            want += texts[r.i][at:a] + by if a >= at else ""
            at = max(at, b)
        assert r.out == want + texts[r.i][at:]


def test_many_matches_take_little_time(spark):
    import time

    text = "1.2.3.4 a@b.c " * 20_000
    began = time.time()
    row = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text == "<IP> <EMAIL> " * 20_000 and time.time() - began < 60


def test_nothing_found(spark):
    docs = spark.createDataFrame([(1, "plain")], "doc_id long, text string")
    assert pii.find_pii(docs).first().term == [] and pii.find_pii(docs.limit(0)).count() == 0
