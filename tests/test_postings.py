"""Posting lists with bounds against the search by blocks."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve


def made(spark, n_queries=60, n_chunks=900):
    rng = random.Random(9)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(700)]
    text = lambda n, m: " ".join(rng.choices(common, k=n) + rng.choices(rare, k=m))
    chunks = [(i % 500, text(rng.randint(0, 6), rng.randint(0, 20)), f"s{i % 3}") for i in range(n_chunks)] + [(1000, None, "s0"), (1001, "", "s1"), (None, "c1 r1", "s0")]
    queries = [(i, text(rng.randint(0, 4), rng.randint(0, 6)), f"s{i % 4}") for i in range(n_queries)] + [(200 + i, chunks[i * 7][1], chunks[i * 7][2]) for i in range(40)] + [(300, None, "s0"), (301, "", "s1"), (302, "zzz", "s2"), (303, "c0 c1 c2", "s0")]
    return spark.createDataFrame(queries, "query_id int, text string, s string"), spark.createDataFrame(chunks, "chunk_id int, text string, s string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("search, where", [(retrieve.keyword_topk, None), (retrieve.jaccard_topk, ["s"])], ids=["keyword", "jaccard"])
def test_equals_the_search_by_blocks(spark, search, where):
    queries, chunks = made(spark)
    want = rows(search(queries, chunks.filter("chunk_id IS NOT NULL"), 7, where=where))
    assert rows(search(queries, chunks, 7, where=where, block_rows=0)) == want


def test_frequent_words_are_read_for_few_queries(spark, monkeypatch):
    queries, chunks = made(spark)
    dense, plainly = [], retrieve._meet
    monkeypatch.setattr(retrieve, "_meet", lambda some, *rest: dense.append(some.count()) or plainly(some, *rest))
    copied = queries.filter("query_id >= 200 AND query_id < 240").withColumn("query_id", F.explode(F.sequence(F.col("query_id") * 1000, F.col("query_id") * 1000 + 4)))
    retrieve.keyword_topk(copied, chunks, 3, block_rows=0).collect()
    assert sum(dense) == 0  # chunks are not copied, however many queries there are


def test_empty_sides(spark):
    queries, chunks = made(spark)
    assert retrieve.keyword_topk(queries.limit(0), chunks, 3, block_rows=-1).count() == 0
    assert retrieve.jaccard_topk(queries, chunks.limit(0), 3, block_rows=0).count() == 0


@pytest.mark.parametrize("kind", ["keyword", "jaccard"])
def test_a_part_s_tokens_stay_in_arrow(kind):
    rng = random.Random(9)
    block = [(i, rng.sample(range(40), rng.randint(0, 6))) for i in range(30)] + [(30, None), (31, [999])]
    part = [(rng.randint(0, 400), rng.sample(range(40), rng.randint(0, 9)) + list(range(1000 + i, 1300 + i))) for i in range(1500)] + [(401, None), (402, [])]
    named = lambda rows: [None if t is None else [f"w{x}" for x in t] for _, t in rows]
    left = pa.table({"query_id": pa.array([i for i, _ in block], pa.int64()), "query_tokens": pa.array(named(block), pa.list_(pa.string()))})
    right = pa.table({"own": pa.array([i for i, _ in part], pa.int64()), "row_tokens": pa.array(named(part), pa.list_(pa.string()))})
    for step in (100, 1_000_000):
        tracemalloc.start()
        got = retrieve._overlaps(kind, 4, "own")(left, right) if step > 100 else retrieve._overlaps(kind, 4, "own", step)(left, right)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        found = {}
        for q, own, score in zip(*(got[c].to_pylist() for c in ("query_id", "own", "score"))):
            found.setdefault(q, []).append((-score, own))
        for q, asked in block:
            best = {}
            for own, held in part:
                both = len(set(asked or ()) & set(held or ()))
                over = len(asked or ()) + 1 if kind == "keyword" else len(asked or ()) + len(held or ()) - both
                best[own] = max(best.get(own, 0.0), both / over if both else 0.0)
            assert sorted(found[q]) == sorted((-s, own) for own, s in best.items())[:4]
        assert peak < 12_000_000  # the 450,000 tokens as Python strings take 30 MB and more
