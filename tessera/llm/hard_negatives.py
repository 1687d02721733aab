"""Hard negatives by inner product, from cover trees over norm-augmented candidates.

Candidates of one label are dealt into blocks of bounded size. In the task where a block meets a block of anchors, the
candidates get one more component that brings all to the norm of the longest, so that inner products order them as
distances on a sphere do, and a cover tree is built over them: a node's children are a net of its points, found
farthest first, each the centre of what is nearest to it, with the covering radius of all below. The angle between an
anchor and a centre, less or more the angle of the radius, bounds all inner products below a node. The descent goes
from the nodes of highest bound down; nodes that lie outside of all windows of an anchor, or below what is found
already, are skipped; what is left of the leaves is scored exactly, for all anchors that reach a leaf at once.

Anchors and candidates meet twice: with their own label for the positives, and with all others for the negatives,
whose windows follow from the positives' scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.mixing import running
from tessera.session import join_checked, materialise, ship

#: Positives of an anchor, negatives of each, and the window of negatives in hundredths of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Anchors are rows whose id this divides.
EVERY = 100
#: Candidates of a block and anchors of a block, about.
BLOCK_ROWS, ANCHOR_ROWS = 4096, 2048
#: Children of a node and rows of a leaf, at most; a leaf of equal rows may be larger.
FAN, LEAF = 16, 128
#: Scores beyond this count as this.
CAP = 1 << 55

_MOST = np.iinfo(np.int64).max


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``, whose components are whole numbers, exactly; cut at CAP."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.sqrt((a * a).sum(1).max())) * float(np.sqrt((b * b).sum(1).max()))
    if bound < 1 << 23:  # then no partial sum is beyond what a float holds exactly
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 52:
        return (a @ b.T).astype(np.int64)
    exact = [[max(-CAP, min(CAP, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
    return np.array(exact, np.int64)


@dataclass
class CoverTree:
    """Nodes of a tree over ``rows`` in the order of ``place``, a node after its parent; rows ``start:stop`` are below it."""

    rows: np.ndarray
    place: np.ndarray
    norm: float
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of each query with the rows below each node."""
        length = np.sqrt((queries * queries).sum(1, keepdims=True))
        scale = length * self.norm
        at = queries @ self.rows[self.centre].T
        cosine = np.divide(at, scale, out=np.zeros_like(at), where=scale > 0)
        angle = np.arccos(np.clip(cosine, -1.0, 1.0))
        wide = 2 * np.arcsin(np.clip(self.radius / (2 * self.norm), 0.0, 1.0)) if self.norm else np.zeros(len(self.radius))
        slack = 1e-6 * scale + 1.0  # for rounding
        return scale * np.cos(np.minimum(np.pi, angle + wide)) - slack, scale * np.cos(np.maximum(0.0, angle - wide)) + slack


def cover_tree(rows: np.ndarray, fan: int = FAN, leaf: int = LEAF) -> CoverTree:
    """The tree of ``rows``, of which there is one at least."""
    squares = (rows * rows).sum(1)
    norm = float(np.sqrt(squares.max()))
    points = np.column_stack([rows, np.sqrt(np.maximum(0.0, squares.max() - squares))])
    order = np.arange(len(rows))
    nodes: list[list] = []  # centre (a row), radius, start, stop, parent, leaf

    def apart(some: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((points[some] - points[centre]) ** 2).sum(1))

    nodes.append([0, float(apart(order, 0).max()), 0, len(rows), -1, True])
    number = 0
    while number < len(nodes):
        centre, radius, start, stop, _, _ = nodes[number]
        some = order[start:stop].copy()
        if len(some) > leaf and radius > 0:
            near, of, chosen = apart(some, centre), np.zeros(len(some), np.int64), [centre]
            while len(chosen) < fan and near.max() > radius / 2:  # a net: what is chosen stands over half the radius apart
                far = int(near.argmax())
                away = apart(some, int(some[far]))
                closer = away < near
                of[closer], near[closer] = len(chosen), away[closer]
                chosen.append(int(some[far]))
            if len(chosen) == 1:  # all within half the radius: the same node, seen closer
                nodes[number][1] = float(near.max())
                if nodes[number][1] > 0:
                    continue
            else:
                nodes[number][5] = False
                sorted_ = np.argsort(of, kind="stable")
                order[start:stop], near, of = some[sorted_], near[sorted_], of[sorted_]
                edges = np.searchsorted(of, np.arange(len(chosen) + 1))
                for k, point in enumerate(chosen):
                    a, b = int(edges[k]), int(edges[k + 1])
                    nodes.append([point, float(near[a:b].max()), start + a, start + b, number, True])
        number += 1
    columns = [np.array(x) for x in zip(*nodes)]
    return CoverTree(rows, order, norm, columns[0].astype(np.int64), columns[1].astype(float), *[c.astype(np.int64) for c in columns[2:5]], columns[5].astype(bool))


def _best(key: np.ndarray, score: np.ndarray, name: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each key: higher scores first, then lesser names."""
    order = np.lexsort((row, name, -score, key))
    sorted_ = key[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(order) else np.zeros(0, np.int64)
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]


def search(tree: CoverTree, names: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``(query, window, row, score)``: the ``k`` best rows of each window of each query, by score and then name.

    ``low`` and ``high`` hold, for each query, the least and greatest score of its windows; a window whose least is
    above its greatest is empty. ``own`` is the row that a query leaves out, or -1.
    """
    windows = low.shape[1]
    below, above = tree.bounds(queries)
    least = low.copy()  # what a row must reach to be among the best of a window
    kept = tuple(np.zeros(0, np.int64) for _ in range(4))  # query * windows + window, row, score, name
    alive = ((above[:, :, None] >= low[:, None, :]) & (below[:, :, None] <= high[:, None, :]) & (low <= high)[:, None, :]).any(2)
    for number in range(1, len(tree.parent)):  # what lies outside at one level is not looked at below
        alive[:, number] &= alive[:, tree.parent[number]]
    leaves = np.flatnonzero(tree.leaf)
    todo = alive[:, leaves]
    bound = np.where(todo, above[:, leaves], -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    seen, step = 0, 1
    while seen < len(leaves):
        now = np.zeros_like(todo)
        np.put_along_axis(now, order[:, seen : seen + step], True, axis=1)
        now &= todo & (bound >= np.where(low <= high, least, _MOST).min(1, keepdims=True))
        found = [kept]
        for place in np.flatnonzero(now.any(0)):
            who = np.flatnonzero(now[:, place])
            rows = tree.place[tree.start[leaves[place]] : tree.stop[leaves[place]]]
            scores = inner_products(queries[who], tree.rows[rows])
            for w in range(windows):
                a, b = np.nonzero((scores >= least[who, w][:, None]) & (scores <= high[who, w][:, None]))
                if own is not None:
                    other = rows[b] != own[who[a]]
                    a, b = a[other], b[other]
                found.append((who[a] * windows + w, rows[b], scores[a, b], names[rows[b]]))
        key, row, score, name = (np.concatenate(x) for x in zip(*found))
        best = _best(key, score, name, row, k)
        kept = key[best], row[best], score[best], name[best]
        full = np.bincount(kept[0], minlength=low.size) >= k
        worst = np.full(low.size, _MOST)
        np.minimum.at(worst, kept[0], kept[2])
        least = np.where(full, np.maximum(low.ravel(), worst), low.ravel()).reshape(low.shape)
        seen, step = seen + step, step * 2
    return kept[0] // windows, kept[0] % windows, kept[1], kept[2]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers; shorter ones end in zeros."""
    flat = column.combine_chunks()
    lengths, values = np.diff(flat.offsets.to_numpy()), flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(flat), width))
    out[np.repeat(np.arange(len(flat)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max(1, *[int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns])


def _positives_of(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _FOUND.empty_table()
        width = _width(anchors["v"], rows["v"])
        asked, held = _matrix(anchors["v"], width), _matrix(rows["v"], width)
        uids, names = rows["uid"].to_numpy(), rows["vec_id"].to_numpy()
        where = {u: i for i, u in enumerate(uids.tolist())}
        own = np.array([where.get(u, -1) for u in anchors["uid"].to_pylist()], np.int64)
        low = np.full((len(asked), 1), -CAP - 1)
        query, window, row, score = search(cover_tree(held), names, asked, low, -low, k, own)
        return pa.table({"anchor": anchors["uid"].take(pa.array(query)), "window": pa.array(window), "vec_id": pa.array(names[row]), "score": pa.array(score)})

    return run


def _negatives_of(k: int, least: int, most: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if len(anchors) and len(rows):
            anchors = anchors.filter(pa.compute.not_equal(anchors["label"], rows["label"][0]))
        if not len(anchors) or not len(rows):
            return _FOUND.empty_table()
        width = _width(anchors["v"], rows["v"])
        asked, held, names = _matrix(anchors["v"], width), _matrix(rows["v"], width), rows["vec_id"].to_numpy()
        scores = anchors["positive_scores"].to_pylist()
        low, high = np.ones((2, len(asked), max(map(len, scores))), np.int64)
        high[:] = 0
        for i, own in enumerate(scores):
            for j, s in enumerate(own):
                low[i, j], high[i, j] = -(-least * s // 100), most * s // 100
        query, window, row, score = search(cover_tree(held), names, asked, low, high, k)
        return pa.table({"anchor": anchors["uid"].take(pa.array(query)), "window": pa.array(window), "vec_id": pa.array(names[row]), "score": pa.array(score)})

    return run


_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor long, window long, vec_id long, score long"


def candidates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(uid, vec_id, label, v)`` of rows that take part, labels changed where 7 divides the id, components whole numbers."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(finite)
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", changed.alias("label"), whole.alias("v"))


def _meet(anchors: DataFrame, rows: DataFrame, fn) -> DataFrame:
    """``fn`` of every block of ``anchors`` with every block of ``rows`` that it shares an ``(ablock, block)`` with."""
    keys = ["ablock", "block"]
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(fn, _FOUND_DDL)


def mine(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: hard negatives of each anchor and positive.

    Anchors are the rows whose id ``every`` divides. Scores are inner products of components floor(256 x); the best
    score comes first, ties by the smaller id. An anchor's positives are its first other rows of its label; the
    negatives of each the first rows of other labels whose score is from ``least`` to ``most`` hundredths of the
    positive's. Rows with a null id, label, vector or component, or one that is not finite, take no part. A short vector
    counts as one that ends in zeros, an empty one scores 0. Repeated rows are rows of their own, also as anchors; scores
    beyond 2^55 count as 2^55. An empty table, or one without anchors, gives an empty result.
    """
    ship(vectors.sparkSession)
    rows = materialise(candidates(vectors, vec_id, embedding, label), "candidates")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long"))
    labels = materialise(running(sizes, [F.col("label").asc()], {"offset": F.col("blocks")}), "labels")  # blocks are numbered label by label
    total = labels.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    is_anchor = F.col("vec_id") % every == 0
    ablocks = -(-rows.filter(is_anchor).count() // anchor_rows)
    if not ablocks:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    numbered = join_checked(rows, labels.select("label", "blocks", "offset"), "label")
    ablock = F.pmod(F.xxhash64("uid"), F.lit(ablocks))
    block = F.col("offset") + F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks"))
    dealt = numbered.select("uid", "vec_id", "label", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(ablocks - 1)).cast("array<long>")).alias("ablock"))
    anchors = materialise(numbered.filter(is_anchor).withColumn("ablock", ablock), "anchors")

    own = anchors.select("uid", "v", "ablock", F.explode(F.sequence("offset", F.col("offset") + F.col("blocks") - 1)).alias("block"))
    by_score = W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = _meet(own, dealt, _positives_of(positives)).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= positives)
    chosen = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    chosen = materialise(anchors.join(chosen, F.col("uid") == F.col("anchor")).drop("anchor", "offset", "blocks"), "positives")

    asked = chosen.select("uid", "label", "v", "ablock", F.col("positives.score").alias("positive_scores"), F.explode(F.sequence(F.lit(0), F.lit(total - 1)).cast("array<long>")).alias("block"))
    by_score = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    far = _meet(asked, dealt, _negatives_of(negatives, least, most)).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    known = chosen.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("window", "positive")).withColumn("window", F.col("window").cast("long"))
    return far.join(known, ["anchor", "window"]).select("anchor_id", F.col("positive.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


#: The same in SQL.
MINE_SQL = """
WITH r AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM {vectors}
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.uid <> b.uid),
p AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS place FROM s WHERE alike QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.uid, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON p.uid = s.uid AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
