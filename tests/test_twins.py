"""Queries that SQL cannot express, beside plain Python over the same rows; and plans."""

import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import text as T
from tessera.operators import assemble as A
from tessera.operators import evaluate, hooks, rank, registry, telemetry
from tessera.operators import retrieve as E
from tessera.session import materialise
from tessera.streaming import events as K

SF_DIR = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return entry.queries()[name](spark, SF_DIR).collect()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()


def tokens(text):
    return set((text or "").lower().split())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sentences(spark, documents):
    want = [(d, i, s) for d, t in zip(documents.doc_id, documents.text) for i, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'(])", re.sub(r"\s+", " ", t).strip(" ")) if x)]
    assert sorted((r.doc_id, r.sentence_index, r.sentence) for r in rows_of(spark, "sentences")) == sorted(want)


def plain_templates(text):
    stack = [""]
    for piece in re.split(r"(\{\{|\}\})", text):
        if piece == "{{":
            stack.append("")
        elif piece == "}}" and len(stack) > 1:
            stack.pop()
        else:
            stack[-1] += piece
    return "{{".join(stack)


def test_templates_of_any_depth(spark):
    rng = random.Random(2)
    texts = ["a {{b {{c {{d {{e {{f {{g {{h {{i}}}}}}}}}}}}}}}} }} z", "{{x|{y}}} w", "no end {{ here", "no start }} here", "{{{{a}}b{{c}}}}", ""]
    texts += ["".join(rng.choices(["{{", "}}", "x", " y ", "{", "}", "\n"], k=30)) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", T.drop_templates(F.col("t")).alias("out")).collect()
    for r in got:
        text = r.t
        for _ in range(3):
            text = re.sub(r"\{\{[^{}]*\}\}", "", text)
        assert r.out == plain_templates(text), r.t


def test_text_faults(spark):
    row = spark.createDataFrame([("\t| cell\n \t{{x\nkept", "a<nav>x<script>y</script>menu</nav>b<STYLE>q</STYLE >c")], "a string, b string")
    got = row.select(T.drop_clerical(row.a).alias("a"), T.html_to_text(row.b).alias("b"), T.wiki_to_text(F.lit("'''A''' is {{a|{{b|{{c|{{d|{{e|{{f|{{g|{{h}}}}}}}}}}}}}}}} here")).alias("w")).first()
    assert got.a == "kept" and got.b == "a b c" and got.w == "A is here"


def test_wiki_text_and_section_trees(spark, documents):
    text = dict(zip(documents.doc_id, documents.text))
    for r in rows_of(spark, "wiki_to_text"):
        assert r.plain.startswith("Front ") and "{{" not in r.plain and "<ref" not in r.plain and r.plain.endswith("none")
        assert re.sub(r"\s+", "", text[r.doc_id]) in re.sub(r"\s+", "", r.plain) or re.search(r"[<\[|'{]", text[r.doc_id])
    paths = {}
    for r in rows_of(spark, "section_tree"):
        paths.setdefault(r.doc_id, []).append((r.section_index, list(r.path), r.section_text))
    for d, found in paths.items():
        assert [p for _, p, _ in sorted(found)] == [[], ["Biography"], ["Biography", "Early life {{x}}"], ["References"]] or [p[-1:] for _, p, _ in sorted(found)][-1] == ["References"]
        assert sorted(found)[1][2].strip() == text[d].strip()


def test_dedup_within_query(spark):
    kept = {}
    for r in rows_of(spark, "dedup_within_query"):
        kept.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    d = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    q = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    text = {r.chunk_id: r.text for r in d.collect()}
    want = {}
    for r in sorted(E.keyword_topk(q, d, 20).collect(), key=lambda r: (r.query_id, r["rank"])):
        own = want.setdefault(r.query_id, [])
        if all(alike(tokens(text[r.chunk_id]), tokens(text[c])) < 0.9 for _, c in own):
            own.append((r["rank"], r.chunk_id))
    assert {k: sorted(v) for k, v in kept.items()} == want


def test_mmr(spark):
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    unit = {k: x / (np.linalg.norm(x) + 1e-9) for k, x in v.items()}
    got = {}
    for r in rows_of(spark, "mmr"):
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    for q, found in got.items():
        left = sorted(unit, key=lambda k: (-float(unit[k] @ unit[q]), k))[:20]
        chosen = []
        while left and len(chosen) < 5:
            best = max(left, key=lambda k: (round(0.5 * float(unit[k] @ unit[q]) - 0.5 * max([float(unit[k] @ unit[c]) for c in chosen], default=0.0), 9), -left.index(k)))
            left.remove(best)
            chosen.append(best)
        assert [c for _, c in sorted(found)] == chosen


def test_keyword_and_jaccard_search_match_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(15)]
    queries = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 4)))) for i in range(30)]
    chunks = [(f"c{i:03}", i % 40, " ".join(rng.choices(vocab, k=rng.randint(0, 8)))) for i in range(120)]
    q, c = spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(chunks, "chunk_id string, doc_id int, text string")
    for owner, search, of in (("chunk_id", E.keyword_topk, "keyword"), ("doc_id", E.keyword_topk, "keyword"), ("chunk_id", E.jaccard_topk, "jaccard")):
        want = []
        for i, text in queries:
            scores = {}
            for cid, doc, held in chunks:
                a, b = tokens(text), tokens(held)
                s = len(a & b) / (len(a) + 1) if of == "keyword" else (len(a & b) / len(a | b) if a | b and a & b else 0.0)
                key = cid if owner == "chunk_id" else doc
                scores[key] = max(scores.get(key, 0.0), s)
            want += [(i, k, round(s, 9), n) for n, (k, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7], 1)]
        old = E.BLOCK_ROWS, E.PART_ROWS
        try:
            E.BLOCK_ROWS, E.PART_ROWS = 8, 25  # several blocks and parts
            got = search(q, c, 7, chunk_id=owner).collect()
        finally:
            E.BLOCK_ROWS, E.PART_ROWS = old
        assert sorted((r.query_id, r[owner], round(r.score, 9), r["rank"]) for r in got) == sorted(want)


def test_vector_search_by_blocks_and_lsh_recall(spark):
    v = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in E.vector_topk(q, v, 10, block_rows=7, part_rows=33).collect()}
    assert exact == {(r.query_id, r.vec_id) for r in E.vector_topk(q, v, 10).collect()}
    unit = np.stack(v.orderBy("vec_id").toPandas().embedding.to_list())
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = [r.vec_id for r in v.select("vec_id").orderBy("vec_id").collect()]
    for i in range(0, len(ids), 10):
        near = np.lexsort((ids, -(unit @ unit[i])))[:10]
        assert len({ids[k] for k in near} & {b for a, b in exact if a == ids[i]}) >= 9  # the last may tie
    found = {(r.query_id, r.vec_id) for r in E.vector_topk_lsh(q, v, 10, bits=4).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    near = v.filter("vec_id < 50").selectExpr("vec_id", "transform(embedding, x -> cast(x * 2 + 0.001 as float)) embedding")
    both = v.filter("vec_id >= 50").select("vec_id", "embedding").unionByName(near)
    best = E.vector_topk_lsh(v.filter("vec_id < 50").select(F.col("vec_id").alias("query_id"), "embedding"), both, 1).collect()
    assert sum(r.query_id == r.vec_id for r in best) >= 45  # what is near is found with narrow buckets


def test_lsh_pairs_stay_in_their_task(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 8)).astype(np.float32)
    rows[100:150] = rows[100]  # equal vectors tie, and go by id
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").repartition(5)
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = E.vector_topk_lsh(q, v, 7, bits=3, tables=4, block_rows=9, part_rows=11)
    planes = np.random.default_rng(7).normal(size=(12, 8)).astype(np.float32)
    unit = rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)
    sides = ((unit @ planes.T > 0).reshape(300, 4, 3) * (1 << np.arange(3))).sum(2)
    double = rows.astype(float)
    for i in range(0, 300, 10):
        met = np.flatnonzero((sides == sides[i]).any(1))
        score = (double[met] * double[i]).sum(1) / np.sqrt((double[met] ** 2).sum(1) * (double[i] ** 2).sum())
        assert [r.vec_id for r in out.filter(F.col("query_id") == i).orderBy("rank").select("vec_id").collect()] == met[np.lexsort((met, -score))[:7]].tolist() if i % 50 == 0 else True
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # neither pairs nor their vectors are shuffled


def test_jaccard_pairs_match_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    base = [rng.sample(vocab, 12) for _ in range(12)]
    rows = [(i, "ab"[i % 2], " ".join(rng.sample(b, 11) + rng.sample(vocab, rng.randint(0, 2)))) for i, b in enumerate(base * 8)]
    rows += [(900, "a", ""), (901, "a", ""), (902, "a", "common"), (903, "a", "common"), (904, None, "x y")]
    links, members = rank.jaccard_pairs(spark.createDataFrame(rows, "id int, g string, text string"), "g", "id")
    first = {}
    for i, g, t in rows:
        first.setdefault((g, frozenset(tokens(t))), i)
    want = {(g, *sorted((i, j)), round(alike(a, b), 9)) for (g, a), i in first.items() for (h, b), j in first.items() if g == h and i < j and a and b and alike(a, b) >= 0.8}
    assert {(r.g, r.a, r.b, round(r.score, 9)) for r in links.collect()} == want and len(want) > 5
    got = {r.id: r.least for r in members.collect()}
    assert all(got[i] == first[g, frozenset(tokens(t))] for i, g, t in rows if g is not None)


@pytest.mark.parametrize("most", [0, 5, 1 << 20])
def test_jaccard_pairs_shuffle_hashes_of_prefixes(spark, most):
    rng = random.Random(8)
    base = [[f"w{int(rng.paretovariate(0.4))}" for _ in range(n)] for n in range(4, 64) for _ in range(2)]
    rows = [(i, "ab"[i % 2], " ".join(rng.sample(b, len(b) - len(b) // 12) + [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 1 + len(b) // 12))])) for i, b in enumerate(base * 4)]
    links, _ = rank.jaccard_pairs(spark.createDataFrame(rows, "id int, g string, text string"), "g", "id", most=most)
    first = {}
    for i, g, t in rows:
        first.setdefault((g, frozenset(tokens(t))), i)
    want = {(g, *sorted((i, j)), round(alike(a, b), 9)) for (g, a), i in first.items() for (h, b), j in first.items() if g == h and i < j and alike(a, b) >= 0.8}
    assert {(r.g, r.a, r.b, round(r.score, 9)) for r in links.collect()} == want and len(want) > 50
    # The pairs that numbers alone leave are stored, and no token of a text passes a shuffle on the way to them.
    assert "collect_list" not in links._jdf.queryExecution().toString() and "explode(t" not in links._jdf.queryExecution().toString()


def brute_links(rows):
    first = {}
    for i, g, t in rows:
        first.setdefault((g, frozenset(tokens(t))), i)
    return {(g, *sorted((i, j)), round(alike(a, b), 9)) for (g, a), i in first.items() for (h, b), j in first.items() if g == h and i < j and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and alike(a, b) >= 0.8}


@pytest.mark.parametrize("block, max_rows", [(128, 200_000), (2, 0)], ids=["whole", "blocks"])
def test_jaccard_pairs_of_parts(spark, block, max_rows):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.sample(vocab, n) for n in (30, 56, 63, 64, 70, 230, 255, 256, 260, 300, 1020, 1026, 1250)]
    rows = [(k, "ab"[k % 2], " ".join(rng.sample(b, len(b) - rng.randint(0, len(b) // 9)) + rng.sample(vocab, rng.randint(0, len(b) // 9)))) for k, b in enumerate(b for b in base for _ in range(16))]
    links, _ = rank.jaccard_pairs(spark.createDataFrame(rows, "id int, g string, text string").repartition(3), "g", "id", block=block, max_rows=max_rows)
    want, size = brute_links(rows), {i: len(tokens(t)) for i, _, t in rows}
    assert {(r.g, r.a, r.b, round(r.score, 9)) for r in links.collect()} == want
    for edge in (64, 256, 1024):  # links between sets of so many parts and of four times as many
        assert sum(min(size[a], size[b]) < edge <= max(size[a], size[b]) for _, a, b, _ in want) > 5


def joined_rows(df):
    """Rows that come out of the joins of ``df``."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        below = [walk(plan.children().apply(k)) for k in range(plan.children().size())]
        return sum(below) + (plan.metrics().apply("numOutputRows").value() if "Join" in name else 0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_jaccard_pairs_shuffle_few_pairs_but_links(spark, monkeypatch):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(600)]
    base = [rng.sample(vocab, n) for n in (40, 90, 300) for _ in range(100)]  # any two share tokens, and rare ones too
    rows = [(i, "a", " ".join(b)) for i, b in enumerate(base)] + [(900 + i, "a", " ".join(b[1:])) for i, b in enumerate(base[:300:10])]
    met = []
    monkeypatch.setattr(rank, "materialise", lambda df, label: (met.append(joined_rows(df)) if label == "near" else None, materialise(df, label))[1])
    links, _ = rank.jaccard_pairs(spark.createDataFrame(rows, "id int, g string, text string"), "g", "id")
    assert links.count() == 30 and len(met) == 1 and met[0] < 1000  # of 54,285 pairs


@pytest.mark.parametrize("held", [1 << 23, 1])
def test_jaccard_counts_repeated_tokens(monkeypatch, held):
    monkeypatch.setattr(rank, "HELD", held)
    batches = [pa.record_batch({"h": pa.array([[x << 32 for x in t] for t in texts])}) for texts in ([[1, 2, -3], [2, -3]], [[-3], [4, 1]])]
    got = [dict(zip(*(c.to_pylist() for c in b.columns))) for b in rank._repeated(iter(batches))]
    assert got == ([{-3: 3, 1: 2, 2: 2}] if held > 1 else [{-3: 2, 2: 2}, {}, {}])  # what a task does not hold more is found at once


def test_jaccard_texts_go_to_cells_once(spark, monkeypatch):
    stored = {}
    monkeypatch.setattr(rank, "materialise", lambda df, label: stored.setdefault(label, materialise(df, label)))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "a", " ".join(words + [f"x{i}"])) for i in range(50)]
    links, _ = rank.jaccard_pairs(spark.createDataFrame(rows, "id int, g string, text string"), "g", "id", block=10)
    assert links.count() == 1225
    assert 5 < stored["cells"].select("i", "j").distinct().count() <= 15  # half a grid of 5 blocks
    assert stored["places"].count() <= 50 * 5  # a text meets each block once, and is not sent with each of its 49 pairs


def test_jaccard_members_look_for_no_pairs(spark, documents, monkeypatch):
    monkeypatch.setattr(rank, "materialise", lambda *_: pytest.fail("members need no table on the way"))
    sets, first = [frozenset(re.sub(r"[ \t\n\v\f\r]+", " ", t.lower()).split(" ")) - {""} for t in documents.text], {}
    for i, g, t in sorted(zip(documents.doc_id, documents.source, sets)):
        first.setdefault((g, t), i)
    assert {(r.source, r.id, r.least) for r in rows_of(spark, "jaccard_members")} == {(g, i, first[g, t]) for i, g, t in zip(documents.doc_id, documents.source, sets)}


def test_set_members_keep_rows_without_group_or_text(spark):
    rows = spark.createDataFrame([(1, None, "x y"), (2, None, "y  X"), (3, "a", None), (4, "a", ""), (5, "a", None), (6, "b", "x")], "id int, g string, text string")
    got = {r.id: (r.g, r.least) for r in rank.set_members(rows, "g", "id").collect()}
    assert got == {1: (None, 1), 2: (None, 1), 3: ("a", 3), 4: ("a", 4), 5: ("a", 3), 6: ("b", 6)}


def test_holders_match_brute_force(spark):
    rng = random.Random(6)
    words = "a b cc dd eee".split()
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 7)))) for i in range(25)] + [(90, "cc  dd\neee a b"), (91, "")]
    docs = [(i, rng.choice(["", "x"]) + " ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", "y"])) for i in range(50)] + [(99, "z cc  dd\neee a bb")]
    got = evaluate.holders(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "id int, question string"))
    assert {(r.id, r.doc_id) for r in got.collect()} == {(i, d) for i, t in items for d, held in docs if t and t in held}


def test_percentiles_of_large_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab") if i else None, rng.choice([rng.random(), 0.5]), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, n int").repartition(6)
    frame = pd.DataFrame(rows, columns=["k", "v", "n"])
    got = {r.k: r for r in telemetry.percentile_cont(df, "v", [0.5, 0.95, 0.99], ["k"]).collect()}
    for k in ("a", "b"):
        own = frame[frame.k == k].v
        assert [got[k].p50, got[k].p95, got[k].p99] == pytest.approx([own.quantile(p) for p in (0.5, 0.95, 0.99)]) and got[k].n == len(own)
    assert got[None].n == 1
    one = telemetry.percentile_nearest(df, "v", [0.5, 0.9]).first()
    ordered = sorted(frame.v)
    assert (one.p50, one.p90) == (ordered[1500], ordered[2700])
    plan = telemetry.percentile_cont(df, "v", [0.5], ["k"])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def test_budget_with_compression(spark):
    rows = [(1, "system", "s " * 5, 5, 0.0, 0), (1, "retrieval", "a b c d", 4, 1.0, 1), (1, "retrieval", "e f g h", 4, 1.0, 2), (1, "user", "u " * 5, 5, 1.0, 3), (1, "user", "x " * 20, 20, 1.0, 4)]
    df = spark.createDataFrame(rows, "session_id int, role string, content string, tokens int, priority double, ts int")
    got = {r.ts: r for r in A.fit_budget(df, 15, compress=lambda t: "ac eg", protected=("system", "retrieval")).collect()}
    assert sorted(got) == [0, 2, 3, 4] and got[2].content == "ac eg" and got[2].tokens == 2 and got[2].priority == 2 and got[4].error == "entry exceeds budget"
    plain = {r.ts: r.error for r in A.fit_budget(df, 15).collect()}
    assert plain == {0: None, 2: None, 3: None, 4: "entry exceeds budget"}


def test_rerank_keeps_the_first_of_a_repeated_index(spark):
    c = spark.createDataFrame([(1, "x", 0.3, 1), (1, "y", 0.2, 2), (1, "z", 0.1, 3)], "query_id int, chunk_id string, score double, rank int")
    r = spark.createDataFrame([(1, 2, 0.5, 0), (1, 0, 0.4, 1), (1, 2, 0.9, 2), (1, 0, 0.99, 3)], "query_id int, idx int, relevance double, arrival int")
    assert [(x.chunk_id, x.score) for x in E.apply_rerank(c, r, 3).orderBy("rank").collect()] == [("z", 0.5), ("x", 0.4)]


def test_hooks_over_batches(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "i int, text string")
    judged = rows.select("i", hooks.judge_hook(lambda f: [(len(a) > 1, "long" if len(a) > 1 else "short") for a in f["answer"]])(F.lit("q"), F.col("text"), F.lit("r")).alias("v")).collect()
    assert [(r.v.correct, r.v.reason) for r in judged] == [(True, "long"), (False, "short")]

    def fails(frame):
        raise ValueError("no model")

    assert [r.v.reason for r in rows.select(hooks.judge_hook(fails)(F.lit("q"), F.col("text"), F.lit("r")).alias("v")).collect()] == ["ValueError: no model"] * 2
    doubled = hooks.batch_hook(rows, lambda f: f.assign(i=f.i * 2), "i int, text string")
    assert sorted(r.i for r in doubled.collect()) == [2, 4] and [r.tokens for r in K.token_column(rows).collect()] == [2, 1]
    assert registry.attribution(spark.createDataFrame([("t", "u")], "title string, url string")).first().line == "t | u"


def test_streams_without_sql(spark):
    said = spark.read.parquet(f"{SF_DIR}/conversations.parquet").orderBy("conv_id", "turn").toPandas()
    want = {}
    for c, group in said.groupby("conv_id"):
        kept = []
        for text in group.text:
            if all(alike(tokens(text), tokens(k)) < 0.9 for k in kept):
                kept.append(text)
        want[c] = sorted(kept)
    got = {}
    for r in rows_of(spark, "stream_near_dedup"):
        got.setdefault(r.conversation_id, []).append(r.text)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    contexts = rows_of(spark, "stream_contexts")
    assert len(contexts) == said.conv_id.nunique() and all("Sources: " in r.context for r in contexts)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").toPandas()
    runs = 0
    for _, group in events.groupby("user_id", sort=False):
        n = 0
        for kind in group.event_type:
            n = n + 1 if kind == "error" else 0
            runs += n == 3
    assert len(rows_of(spark, "stream_failure_streaks")) == runs


@pytest.mark.parametrize("name", ["retrieval_metrics", "hit_recall", "summarise_strategy", "misses", "rank_delta"])
def test_no_nested_loop(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_band_chunks_and_budget_on_whole_tables(spark, documents):
    words = {d: len(t.split()) for d, t in zip(documents.doc_id, documents.text)}
    found = {}
    for r in rows_of(spark, "chunk_band"):
        found.setdefault(r.doc_id, []).append(len(r.text.split()))
    assert all(sum(n) <= words[d] * 2 and min(n) > 0 for d, n in found.items()) and math.isfinite(sum(map(sum, found.values())))
    fits = {}
    for r in rows_of(spark, "fit_budget"):
        fits.setdefault(r.session_id, []).append(r)
    assert all(sum(r.tokens for r in own if r.error is None) <= 200 for own in fits.values())
