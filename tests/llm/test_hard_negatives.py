"""Cover trees against all inner products, and hard negatives against a plain search."""

import math

import numpy as np
import pytest

from tessera.llm import hard_negatives as H


def plain(rows):
    """Rows of the result by the definition."""
    live = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        live.append((vec_id, label, [math.floor(256 * x) for x in v]))
    score = lambda a, b: max(-H.CAP, min(H.CAP, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, (anchor, label, v) in enumerate(live):
        if anchor % 100:
            continue
        scored = [(-score(v, w), n, kind) for j, (n, kind, w) in enumerate(live) if j != i]
        for ps, positive, _ in sorted(x for x in scored if x[2] == label)[:5]:
            window = sorted(x for x in scored if x[2] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:10]
            out += [(anchor, positive, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(window)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(map(tuple, H.mine(df, **kw).collect()))


def near(rng, n, width=6, copies=0):
    v = rng.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if copies:
        v[rng.choice(n, copies, replace=False)] = v[0]
    return v.astype(np.float32)


def vectors(n=700, copies=200, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(near(rng, n, copies=copies))]


def test_equals_the_plain_search_in_blocks_of_any_size(spark):
    rows = vectors()
    want = plain(rows)
    assert len(want) > 100
    assert found(spark, rows) == want
    assert found(spark, rows, block_rows=50, anchor_rows=3) == want


def test_nulls_odd_vectors_repeats_and_large_numbers(spark):
    rows = vectors(250, 60, 4)
    rows += [(None, [1.0], 1), (300, None, 1), (400, [1.0, None], 1), (500, [float("nan")], 2), (600, [float("inf")], 2), (700, [0.5], None)]
    rows += [(200, rows[200][1], rows[200][2])] * 3 + [(800, [], 1), (900, [0.3], 1), (1000, [0.0] * 6, 2), (1001, [0.2] * 9, 3), (-100, [0.1] * 6, 1), (-7, [0.3] * 6, -4)]
    assert found(spark, rows) == plain(rows)
    rows = [(i, [float(x) * 1e12 for x in v], k) for i, v, k in vectors(120, 20, 6)]
    assert found(spark, rows) == plain(rows)


def test_empty_tables_and_tables_without_anchors_or_positives(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(100, [1.0], 1), (2, [0.5], 2)]) == []
    assert found(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(100, 1, 1, 2, 65536, 32768)]


@pytest.mark.parametrize("copies", [0, 900])
def test_tree_covers_its_rows_and_bounds_hold(copies):
    rng = np.random.default_rng(copies)
    rows = np.floor(256 * near(rng, 1500, 5, copies) * rng.uniform(0.2, 1, (1500, 1)))
    tree = H.cover_tree(rows, leaf=40)
    squares = (rows**2).sum(1)
    points = np.column_stack([rows, np.sqrt(squares.max() - squares)])
    queries = np.floor(256 * near(rng, 30, 5))
    scores = queries @ rows.T
    below, above = tree.bounds(queries)
    for i in range(len(tree.parent)):
        some = tree.place[tree.start[i] : tree.stop[i]]
        assert np.sqrt(((points[some] - points[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
        assert (scores[:, some].max(1) <= above[:, i]).all() and (scores[:, some].min(1) >= below[:, i]).all()
        kids = np.flatnonzero(tree.parent == i)
        assert tree.leaf[i] or tree.centre[i] in tree.centre[kids]  # centres stay centres at the level below
        assert not tree.leaf[i] or len(some) <= 40 or tree.radius[i] == 0
    assert sorted(tree.place[np.concatenate([np.arange(tree.start[i], tree.stop[i]) for i in np.flatnonzero(tree.leaf)])]) == list(range(1500))


def test_the_descent_skips_what_is_outside():
    rng = np.random.default_rng(1)
    centres = near(rng, 20, 16)
    rows = np.floor(256 * (np.repeat(centres, 200, 0) + rng.normal(size=(4000, 16)) * 0.01))
    tree, asked = H.cover_tree(rows), []
    plainly, H.inner_products = H.inner_products, lambda a, b: asked.append(a.shape[0] * b.shape[0]) or plainly(a, b)
    try:
        low = np.full((20, 1), -H.CAP)
        query, window, row, score = H.search(tree, np.arange(4000), np.floor(256 * centres), low, -low, 5)
    finally:
        H.inner_products = plainly
    assert sum(asked) < 0.25 * 20 * 4000
    want = np.floor(256 * centres) @ rows.T
    assert (np.sort(score.reshape(20, 5)) == np.sort(np.sort(want, axis=1)[:, -5:])).all()
