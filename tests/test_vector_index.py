"""The inverted file against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve as E
from tessera.operators import vector_index as V


def clustered(spark, n=4000, centres=40, width=24, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width)) * 3
    rows = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("name, cells, probes, rerank", [("given", 32, 24, 15), ("clustered", 40, 5, 5)])
def test_recall_and_share_of_pairs(spark, name, cells, probes, rerank):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet") if name == "given" else clustered(spark)
    q = v.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    n, asked = v.count(), q.count()
    index = V.build(v, cells=cells)
    assert index.rows == n and index.lists.count() == n
    exact = {(r.query_id, r.vec_id) for r in E.vector_topk(q, v, 10).collect()}
    found = V.search(index, q, 10, probes, rerank).collect()
    got = {(r.query_id, r.vec_id) for r in found}
    assert len(got) == 10 * asked and len(exact & got) >= 0.9 * len(exact)
    assert V.candidates(index, q, probes, rerank * 10).count() < 0.15 * n * asked
    if name == "clustered":  # there the lists that are read are a small share too
        read = index.lists.groupBy("cell").count().agg(F.sum(F.col("count") ** 2)).first()[0] * probes / n**2
        assert read < 0.3
    scores = {(r.query_id, r.vec_id): r.score for r in E.vector_topk(q, v, 10).collect()}
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-5 for r in found if (r.query_id, r.vec_id) in scores)


def test_hot_cells_repeats_nulls_and_empty_tables(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(60 + i, [0.0, 1.0, float(i)]) for i in range(20)] + [(90, None), (91, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = V.build(v, cells=4, pieces=2, part_rows=7)
    assert index.parts.agg(F.max("parts")).first()[0] >= 8
    q = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    got = V.search(index, q, 5, probes=4).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: (r.query_id, r.rank)) if r.query_id == 1] == [0, 1, 2, 3, 4]
    assert sum(r.query_id == 2 for r in got) == 5
    empty = V.build(v.limit(0))
    assert empty.rows == 0 and V.search(empty, q, 3).count() == 0
