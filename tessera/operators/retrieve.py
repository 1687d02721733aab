"""Retrieval: a table of queries against a table of chunks.

Top-k searches deal queries into blocks and chunks into parts, both of bounded size. Each block meets each part in
one task, which passes on k rows a query, so that a frequent token or a large table makes more tasks and no larger
ones, and what is shuffled after that is small.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import join_checked, materialise

DEFAULT_K = 5
#: Chunks for a mode; other modes take 3.
MODE_K = {"deep_research": 10, "open_analysis": 7, "perspective_shift": 5, "exam_grader": 5, "debate": 7, "satirical_podcast": 6}
#: Query rows whose tokens are broadcast; more are joined by shuffle.
BROADCAST_QUERIES = 20_000
#: Queries of a block and rows of a part, about; tasks in which blocks meet parts, at most (a task may take several in turn).
BLOCK_ROWS, PART_ROWS, MOST_TASKS = 8_192, 20_000, 20_000
#: Rows of a part whose tokens meet a block, about; cells of rows and queries that are counted at once, about.
TOKEN_ROWS, STEP_CELLS = 8_000, 1_000_000
#: Aliases of one automaton, about.
ALIAS_ROWS = 200_000
#: Characters of a word at whose end an alias does not end.
WORD = frozenset(string.ascii_letters + string.digits + "_")


def topk(rows: DataFrame, k: int | Column | None = None, by: str = "score", key: str = "query_id", order: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``; ties by ``order``. Spark cuts each task's rows to k before the shuffle."""
    if isinstance(k, Column):
        limit = k
    else:
        limit = F.lit(k or DEFAULT_K)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(by), *order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _shared_tokens(queries: DataFrame, chunks: DataFrame, query_text: str, chunk_text: str, chunk_id: str, where: list[str] | None) -> DataFrame:
    """``(query_id, chunk_id, shared, n_query, n_chunk)`` for pairs that share a token; an equi-join on tokens."""
    keys = where or []
    q = queries.select("query_id", *keys, T.token_set(F.col(query_text)).alias("t")).select("query_id", *keys, F.size("t").alias("n_query"), F.explode("t").alias("token"))
    c = chunks.select(chunk_id, *keys, T.token_set(F.col(chunk_text)).alias("t")).select(chunk_id, *keys, F.size("t").alias("n_chunk"), F.explode("t").alias("token"))
    small = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    met = c.join(F.broadcast(q) if small else q, ["token", *keys])
    return met.groupBy("query_id", chunk_id, "n_query", "n_chunk").agg(F.count("*").alias("shared"))


def keyword_scores(queries: DataFrame, chunks: DataFrame, query_text: str = "text", chunk_text: str = "text", chunk_id: str = "chunk_id", where: list[str] | None = None) -> DataFrame:
    """``(query_id, chunk_id, score)`` with score shared tokens over query tokens plus one; pairs without a shared token score 0 and are left out.

    ``where`` names columns of both sides that must be equal.
    """
    met = _shared_tokens(queries, chunks, query_text, chunk_text, chunk_id, where)
    return met.select("query_id", chunk_id, (F.col("shared") / (F.col("n_query") + 1)).alias("score"))


def _meet(queries: DataFrame, rows: DataFrame, owner: str, where: list[str], fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int, part_rows: int) -> DataFrame:
    """``fn`` of every block of ``queries`` with every part of ``rows``; rows of one ``owner`` are in one part.

    Columns ``where`` must be equal on both sides.
    """
    blocks = max(1, -(-queries.count() // block_rows))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // part_rows))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", numbers(parts))
    right = rows.withColumn("part", F.pmod(F.xxhash64(owner), F.lit(parts)).cast("int")).withColumn("block", numbers(blocks))
    keys = ["block", "part", *where]
    tasks = min(blocks * parts, MOST_TASKS)  # alike on both sides, which adaptive execution must not coalesce apart
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(fn, schema)


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query; ties go to the lesser row."""
    order = np.lexsort((row, -score, query))
    asked = query[order]
    first = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, np.int64)
    return order[np.arange(len(asked)) - np.repeat(first, np.diff(np.append(first, len(asked)))) < k]


def _codes(lists: pa.ChunkedArray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``words`` of the tokens of lists, of those that are in it, with the number of their list; sizes of all lists."""
    code, row, size, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for part in lists.chunks:
        found = pc.index_in(part.flatten(), words)
        kept = found.is_valid()
        code.append(found.filter(kept).to_numpy(zero_copy_only=False).astype(np.int64))
        row.append(pc.list_parent_indices(part).filter(kept).to_numpy(zero_copy_only=False).astype(np.int64) + at)
        size.append(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at += len(part)
    return np.concatenate(code), np.concatenate(row), np.concatenate(size)


def _overlaps(kind: str, k: int, owner: str, step: int = STEP_CELLS) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best rows of a part for each query of a block by shared tokens; rows without a shared token come last.

    Tokens stay in Arrow and become numbers there, those alone that the block has. Rows meet the queries in steps of
    about ``step`` cells, after each of which k rows a query are kept, so that memory is bounded by the part's Arrow rows.
    """

    def run(block: pa.Table, part: pa.Table) -> pa.Table:
        asked, total = block["query_id"], block.num_rows
        words = pc.unique(pa.chunked_array([c.flatten() for c in block["query_tokens"].chunks], block.schema.field("query_tokens").type.value_type)).drop_null()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        ids = pc.unique(part[owner])
        ids = ids.take(pc.sort_indices(ids))
        owners = pc.index_in(part[owner], ids).to_numpy().astype(np.int64)
        code, query, n_query = _codes(block["query_tokens"], words)
        posted = query[np.argsort(code, kind="stable")]  # queries by token
        begins = np.append(0, np.cumsum(np.bincount(code, minlength=len(words))))
        code, row, n_row = _codes(part["row_tokens"], words)
        often = np.diff(begins)[code] if len(words) else np.zeros(0, np.int64)
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))

        cost = np.cumsum(total + np.bincount(row, weights=often, minlength=len(owners)).astype(np.int64))
        cuts = np.flatnonzero(np.diff(cost // step, prepend=0)) if len(cost) else np.zeros(0, np.int64)
        cuts = np.unique(np.concatenate(([0], cuts, [len(owners)]))).astype(np.int64)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            first, last = np.searchsorted(row, [low, high])
            times, tokens = often[first:last], code[first:last]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begins[tokens], times)
            shared = np.bincount(np.repeat(row[first:last] - low, times) * total + posted[place], minlength=0)
            cell = np.flatnonzero(shared)
            both, new_row, new_query = shared[cell].astype(np.float64), cell // total + low, cell % total
            score = both / (n_query[new_query] + 1) if kind == "keyword" else both / (n_query[new_query] + n_row[new_row] - both)
            query, own, score = (np.concatenate(x) for x in zip(kept, (new_query, owners[new_row], score)))
            order = np.lexsort((-score, own, query))  # of an owner's rows the best
            new = np.append(True, (query[order][1:] != query[order][:-1]) | (own[order][1:] != own[order][:-1])) if len(order) else np.zeros(0, bool)
            query, own, score = (x[order[new]] for x in (query, own, score))
            best = _best(query, own, score, k)
            kept = query[best], own[best], score[best]
        counts = np.bincount(kept[0], minlength=total)
        begun = np.append(0, np.cumsum(counts))
        waiting = []
        for query in np.flatnonzero(counts < min(k, len(ids))).tolist():
            there = set(kept[1][begun[query] : begun[query + 1]].tolist())
            rest = [i for i in range(min(len(ids), k + len(there))) if i not in there][: k - len(there)]
            waiting.append((np.full(len(rest), query), np.array(rest, np.int64), np.zeros(len(rest))))
        query, own, score = (np.concatenate(x) for x in zip(kept, *waiting))
        return pa.table({"query_id": asked.take(pa.array(query)), owner: ids.take(pa.array(own)), "score": pa.array(score)})

    return run


def _token_topk(kind: str, queries: DataFrame, chunks: DataFrame, k: int | None, owner: str, query_text: str, chunk_text: str, where: list[str] | None, block_rows: int) -> DataFrame:
    keys, k = where or [], k or DEFAULT_K
    q = queries.select("query_id", *keys, T.token_set(F.col(query_text)).alias("query_tokens"))
    c = chunks.select(owner, *keys, T.token_set(F.col(chunk_text)).alias("row_tokens"))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, {owner} {c.schema[owner].dataType.simpleString()}, score double"
    by_blocks = lambda some: _meet(some, c, owner, keys, _overlaps(kind, k, owner), schema, BLOCK_ROWS, TOKEN_ROWS)
    if queries.limit(block_rows + 1).count() <= block_rows:  # one block: the chunks are read once as they are
        found = by_blocks(q)
    else:
        from tessera.operators.postings import posting_topk

        found = posting_topk(kind, q, c, k, owner, keys, by_blocks)
    return topk(found, k, order=(owner,))


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int | None = None, chunk_id: str = "chunk_id", query_text: str = "text", chunk_text: str = "text", where: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` best chunks of each query by shared tokens over query tokens plus one; ties by chunk id.

    Chunks without a shared token follow with score 0, so that a query has k rows wherever there are as many chunks.
    ``chunk_id`` may name what several chunks belong to: its best chunk counts. ``where`` names columns of both sides
    that must be equal. Up to ``block_rows`` queries meet all chunks in one block; more are looked up in posting lists.
    """
    return _token_topk("keyword", queries, chunks, k, chunk_id, query_text, chunk_text, where, block_rows)


def jaccard_topk(queries: DataFrame, chunks: DataFrame, k: int | None = None, chunk_id: str = "chunk_id", query_text: str = "text", chunk_text: str = "text", where: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same by the Jaccard index of token sets."""
    return _token_topk("jaccard", queries, chunks, k, chunk_id, query_text, chunk_text, where, block_rows)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers as unit vectors."""
    flat = column.combine_chunks()
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.float32)
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)


def _nearest(k: int, step: int = 1024) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The nearest rows of a part for each query of a block, ``step`` rows of the part at a time."""

    def run(block: pa.Table, part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")  # so that places are in the order of ids
        asked, rows, names = _matrix(block["q"]), _matrix(part["v"]), part["vec_id"].to_numpy()
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for at in range(0, len(rows), step):
            scores = asked @ rows[at : at + step].T
            most = min(k, scores.shape[1])
            near = np.argpartition(-scores, most - 1, axis=1)[:, :most] if len(scores) else np.zeros((0, most), np.int64)
            # Of the rows that are as near as the last one the first by id are as good.
            least = np.take_along_axis(scores, near, 1).min(1, keepdims=True) if len(scores) else scores
            level = scores == least
            free = most - (scores > least).sum(1, keepdims=True)
            query, place = np.nonzero((scores > least) | (level & (np.cumsum(level, axis=1) <= free)))
            found = query, names[at + place], scores[query, place].astype(np.float64)
            both = tuple(np.concatenate(x) for x in zip(kept, found))
            best = _best(*both, k)
            kept = tuple(x[best] for x in both)
        return pa.table({"query_id": block["query_id"].take(pa.array(kept[0])), "vec_id": pa.array(kept[1]), "score": pa.array(kept[2])})

    return run


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = 4 * BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the nearest vectors by cosine, exactly; ties by id."""
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(embedding).cast("array<float>").alias("q"))
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("v"))
    return topk(_meet(q, v, "vec_id", [], _nearest(k), "query_id long, vec_id long, score double", block_rows, part_rows), k, order=("vec_id",))


def _same_sides(k: int, planes: np.ndarray, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each query of a block the nearest of those rows of a part that share a bucket with it."""

    def sided(rows: np.ndarray) -> np.ndarray:
        return ((rows @ planes.T > 0).reshape(len(rows), -1, bits) * (1 << np.arange(bits))).sum(2)

    def run(block: pa.Table, part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")  # so that places are in the order of ids
        asked, rows = (np.zeros((len(c), planes.shape[1])) if not len(c) else c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) for c in (block["q"], part["v"]))
        wanted, held = sided(_matrix(block["q"])) if len(asked) else (), sided(_matrix(part["v"])) if len(rows) else ()
        members = []  # of each table: rows by bucket, and where each bucket begins
        for table in range(len(planes) // bits if len(rows) else 0):
            order = np.argsort(held[:, table], kind="stable")
            members.append((order, np.searchsorted(held[order, table], np.arange((1 << bits) + 1))))
        squares = (rows * rows).sum(1)
        found: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))]
        met = np.zeros(len(rows), bool)
        for i, buckets in enumerate(wanted if len(rows) else ()):
            met[:] = False
            for (order, begins), bucket in zip(members, buckets):
                met[order[begins[bucket] : begins[bucket + 1]]] = True
            near = np.flatnonzero(met)
            with np.errstate(divide="ignore", invalid="ignore"):
                # Row by row, so that equal vectors have equal scores.
                score = (rows[near] * asked[i]).sum(1) / np.sqrt((asked[i] * asked[i]).sum() * squares[near])
            best = np.lexsort((near, -score))[:k] if len(near) <= 4 * k else _first(score, k)
            found.append((np.full(len(best), i), near[best], score[best]))
        query, place, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": block["query_id"].take(pa.array(query)), "vec_id": part["vec_id"].take(pa.array(place)), "score": pa.array(score)})

    return run


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest; ties go to the lesser place."""
    least = np.partition(score, len(score) - k)[len(score) - k]
    near = np.flatnonzero(~(score < least))
    return near[np.lexsort((near, -score[near]))[:k]]


def vector_topk_lsh(queries: DataFrame, vectors: DataFrame, k: int, bits: int = 8, tables: int = 24, seed: int = 7, block_rows: int = 4 * BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Approximate nearest vectors by cosine: those on the same side of ``bits`` random planes, in any of ``tables`` draws, are scored exactly.

    Blocks of queries meet parts of the vectors; a part's vectors are dealt into buckets by their sides, once for each
    table, and a query looks into its own, so that the share of pairs that are compared falls with ``bits`` and pairs are
    not shuffled, only k rows of each query and part. A query whose buckets hold fewer than k vectors gets fewer rows.
    """
    width = vectors.select(F.size("embedding")).first()
    planes = np.random.default_rng(seed).normal(size=(tables * bits, width[0] if width else 1)).astype(np.float32)
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("q"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    return topk(_meet(q, v, "vec_id", [], _same_sides(k, planes, bits), "query_id long, vec_id long, score double", block_rows, part_rows), k, order=("vec_id",))


def with_rerank(candidates: DataFrame, fn: Callable | None, k: int, reverse: bool = False) -> DataFrame:
    """Candidates ``(query_id, chunk_id, text, score, rank)`` reranked and cut to ``k``.

    ``fn`` maps a query's candidates, a pandas frame in rank order, to scores; None keeps the order, ``reverse``
    turns it round. A query on which ``fn`` raises keeps its order and has ``reranked`` false.
    """
    if fn is None:
        order = F.desc("rank") if reverse else F.asc("rank")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(order))
        return candidates.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("reranked", F.lit(reverse))

    def run(frame):
        frame = frame.sort_values("rank", kind="stable").reset_index(drop=True)
        try:
            frame["score"] = np.asarray(fn(frame), float)
            frame = frame.sort_values("score", ascending=False, kind="stable")
            frame["reranked"] = True
        except Exception:  # the hook's own failures leave the base order
            frame["reranked"] = False
        frame["rank"] = np.arange(1, len(frame) + 1)
        return frame.head(k)

    schema = candidates.withColumn("reranked", F.lit(True)).withColumn("rank", F.col("rank").cast("int")).withColumn("score", F.col("score").cast("double")).schema
    return candidates.groupBy("query_id").applyInPandas(run, schema)


def apply_rerank(candidates: DataFrame, results: DataFrame, k: int, fallback: bool = True) -> DataFrame:
    """Candidates in the order of a reranker's ``results(query_id, idx, relevance)``; idx counts from 0.

    Indexes out of range go, and of repeated ones all but the first to arrive, by ``arrival`` where results have it, else
    by the reranker's own order of relevance; with ``fallback`` a query without a result keeps its order.
    """
    order = F.asc("arrival") if "arrival" in results.columns else F.desc("relevance")
    once = results.withColumn("__n", F.row_number().over(W.partitionBy("query_id", "idx").orderBy(order))).filter("__n = 1").drop("__n", "arrival")
    known = candidates.withColumn("idx", F.col("rank") - 1)
    met = known.join(once, ["query_id", "idx"]).withColumn("score", F.col("relevance")).drop("relevance")
    if fallback:
        met = met.unionByName(known.join(once.select("query_id").distinct(), "query_id", "left_anti"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "idx"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).drop("idx")


def min_score(rows: DataFrame, least: float) -> DataFrame:
    """Rows whose score is high enough."""
    return rows.filter(F.col("score") >= least)


def k_for_mode(mode: Column) -> Column:
    """Chunks for a mode."""
    table = F.create_map(*[F.lit(x) for kv in MODE_K.items() for x in kv])
    return F.coalesce(table[mode], F.lit(3))


def split_topk(scoped: DataFrame, general: DataFrame, n_scoped: int = 5, n_general: int = 2, n_alone: int = 7) -> DataFrame:
    """Scored rows of queries with an entity: scoped ones first and then general ones; of other queries general ones alone.

    ``scoped`` holds rows of queries with an entity only.
    """
    keyed = scoped.select("query_id").distinct().withColumn("__e", F.lit(True))
    first = topk(scoped, n_scoped, order=("chunk_id",)).withColumn("part", F.lit(0))
    rest = general.join(keyed, "query_id", "left").withColumn("__k", F.when(F.col("__e"), n_general).otherwise(n_alone))
    rest = topk(rest, F.col("__k"), order=("chunk_id",)).withColumn("part", F.lit(1)).drop("__e", "__k")
    both = first.unionByName(rest)
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("part", "rank"))).drop("part")


def scoped_or_general(scoped: DataFrame, general: DataFrame) -> DataFrame:
    """Scoped rows; of queries without one, general rows."""
    return scoped.unionByName(general.join(scoped.select("query_id").distinct(), "query_id", "left_anti"))


def _alias_finder(known: list[tuple[str, str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(key, size, ordinal, slug)`` of the longest of ``known`` in each text, by one pass of an automaton over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for alias, slug, ordinal in known:
            held = automaton.get(alias, None)
            if held is None or ordinal < held[1]:
                automaton.add_word(alias, (len(alias), ordinal, slug))
        automaton.make_automaton()
        for batch in batches:
            rows = [[], [], [], []]
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                best = None
                for end, found in automaton.iter(text or ""):
                    size, ordinal, slug = found
                    start = end - size + 1
                    if (best is None or (size, -ordinal) > (best[0], -best[1])) and (start == 0 or text[start - 1] not in WORD) and (end + 1 == len(text) or text[end + 1] not in WORD):
                        best = found
                if best is not None:
                    for column, x in zip(rows, (key, *best)):
                        column.append(x)
            keys = pa.array([x.as_py() for x in rows[0]], batch.schema.types[0])
            yield pa.RecordBatch.from_arrays([keys, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())], names=["key", "size", "ordinal", "slug"])

    return run


def detect_alias(rows: DataFrame, text: str, aliases: DataFrame, key: str, part_rows: int = ALIAS_ROWS) -> DataFrame:
    """``rows`` with the ``slug`` of the longest alias in the text, at word boundaries, in any case; ties by ``ordinal``.

    ``aliases(alias, slug, ordinal)`` may be of any size: it is dealt into parts of about ``part_rows``, each of which
    becomes an automaton that reads the texts once. A boundary is the text's end or a character other than A-Z, a-z,
    0-9 and ``_``. Empty and null aliases match nothing, null texts get null, repeated keys are one row's texts together.
    """
    names = materialise(aliases.select(F.lower("alias").alias("alias"), F.col("slug").cast("string").alias("slug"), F.col("ordinal").cast("long").alias("ordinal")).filter("alias <> ''"), "aliases")
    parts = max(1, -(-names.count() // part_rows))
    texts = rows.select(F.col(key).alias("key"), F.lower(text).alias("t")).filter("t IS NOT NULL")
    found = []
    for part in range(parts):
        known = names.filter(F.pmod(F.xxhash64("alias"), F.lit(parts)) == part).collect()  # bounded by part_rows, about
        if known:
            found.append(texts.mapInArrow(_alias_finder([(r.alias, r.slug, r.ordinal) for r in known]), f"key {texts.schema['key'].dataType.simpleString()}, size int, ordinal long, slug string"))
    if not found:
        return rows.withColumn("slug", F.lit(None).cast("string"))
    best = reduce(DataFrame.union, found).groupBy("key").agg(F.max_by("slug", F.struct("size", -F.col("ordinal"))).alias("slug"))
    return rows.join(best.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left").drop("__key")


def normalise_alias(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``slug``: an alias's slug, else the name in lower case with hyphens."""
    known = materialise(aliases.select(F.lower("alias").alias("__alias"), F.col("slug").alias("__slug")), "aliases")
    low = F.lower(F.trim(name))
    return join_checked(rows, known, low == F.col("__alias"), "left").withColumn("slug", F.coalesce("__slug", F.regexp_replace(low, r"\s+", "-"))).drop("__alias", "__slug")


def query_text(*parts: Column) -> Column:
    """Parts of a query joined by blanks."""
    return F.trim(F.concat_ws(" ", *parts))


def distinct_queries(queries: DataFrame, text: str = "text", keys: tuple[str, ...] = ("collection", "k")) -> tuple[DataFrame, DataFrame]:
    """``(once, map)``: each distinct query once with a ``query_key``, and the key of every ``query_id``."""
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lower(F.trim(text))), 256)
    keyed = queries.withColumn("query_key", key)
    once = keyed.groupBy("query_key").agg(F.min(text).alias(text), *[F.first(c).alias(c) for c in keys])
    return once, keyed.select("query_id", "query_key")


def citations(rows: DataFrame, most: int = 5, cut: int = 300) -> DataFrame:
    """The first results with cut texts."""
    return rows.filter(F.col("rank") <= most).withColumn("text", F.substring("text", 1, cut))


def context_string(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``(query_id, context)``: ``[doc_id] text`` blocks in rank order, or a fixed line."""
    blocks = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text"))), lambda s: F.concat(F.lit("["), s.doc_id.cast("string"), F.lit("] "), s.text)), "\n\n").alias("context"))
    return queries.select("query_id").join(blocks, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("No context retrieved.")))
