"""Diversity and near-duplicate removal within the results of a query, which are bounded by its k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.retrieve import topk
from tessera.session import discard, materialise


def mmr(candidates: DataFrame, k: int, weight: float = 0.5, embedding: str | None = "embedding", query: str = "query_embedding") -> DataFrame:
    """Candidates ``(query_id, chunk_id, rank, ...)`` chosen one by one for nearness less redundancy; ties go to the earlier one.

    Without embeddings the best scores are taken.
    """
    if embedding is None:
        return topk(candidates, k, order=("chunk_id",))

    def run(frame):
        frame = frame.sort_values("rank", kind="stable").reset_index(drop=True)
        unit = lambda m: m / (np.linalg.norm(m, axis=-1, keepdims=True) + 1e-9)
        vectors = unit(np.stack(frame[embedding].to_list()).astype(float))
        near = vectors @ unit(np.asarray(frame[query].iloc[0], float))
        left, chosen = list(range(len(frame))), []
        redundancy = np.zeros(len(frame))
        while left and len(chosen) < k:
            value = weight * near[left] - (1 - weight) * redundancy[left]
            pick = left.pop(int(np.argmax(value)))
            same = vectors @ vectors[pick]
            redundancy = same if not chosen else np.maximum(redundancy, same)
            chosen.append(pick)
        out = frame.iloc[chosen].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    schema = candidates.withColumn("rank", F.col("rank").cast("int")).schema
    return candidates.groupBy("query_id").applyInPandas(run, schema)


def dedup_fold(items: Column, tokens: str, threshold: float) -> Column:
    """An ordered array of structs without those whose token set is as like a kept one as ``threshold``."""

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda kept: T.jaccard(kept[tokens], x[tokens]) >= threshold), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, F.slice(items, 1, 0), step)


def dedup_jaccard(rows: DataFrame, threshold: float = 0.95, key: str = "query_id") -> DataFrame:
    """Rows ``(query_id, rank, ...)`` in rank order without near-duplicates of kept ones; two empty texts are alike."""
    fields = [c for c in rows.columns if c != key]
    packed = rows.withColumn("__t", T.token_set(F.col("text"))).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"], "__t"))).alias("items"))
    kept = packed.select(key, F.explode(dedup_fold(F.col("items"), "__t", threshold)).alias("x"))
    return kept.select(key, *[F.col(f"x.{c}").alias(c) for c in fields])


#: Classes of tokens whose numbers of rows order them, at most; below the rarest of these tokens stand in the order of their hashes.
ORDERED_TOKENS = 1 << 20
#: Sets of fewer tokens than this are one part, those of fewer than four times as many four parts, and so on.
PART = 64
#: Classes that a task counts at a time.
HELD = 1 << 23
#: Texts of a block, about; two blocks are compared in one task.
BLOCK = 512
#: Bits that mark ids.
MARKS = 1 << 27


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(h, n)``: classes of tokens, which a task holds more than once, with their numbers; those of one row in each task go uncounted.

    Counts only put tokens in order, and any order gives the same pairs.
    """
    h, n = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1])], names=["h", "n"])

    for batch in batches:
        own, times = np.unique((batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64) >> 32).astype(np.int32), return_counts=True)
        h, at = np.unique(np.concatenate([h, own]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, times]), len(h)).astype(np.int64)
        if len(h) > HELD:
            yield found()
            h, n = h[:0], n[:0]
    yield found()


def _order(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the most frequent tokens of ``counts(h, n)`` in order, at most ``most`` of them, and how many rows hold each."""
    counts = materialise(counts.groupBy("h").agg(F.sum("n").alias("n")), "counts")
    least, total = 2, 0
    sizes = counts.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count("*").alias("rows"), F.max("n").alias("n"))  # a few hundred classes
    for row in sorted(sizes.collect(), key=lambda r: -r.c):
        total += row.rows
        if total > most:
            least = row.n + 1
            break
    found = counts.filter(F.col("n") >= least).toArrow()  # bounded by ``most``
    discard(counts)
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    by = np.argsort(h)
    return h[by], n[by]


def _prefixes(threshold: float, order) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(id, k, h, sketch, before, place)``: the rarest tokens of each part of a set.

    Of each token the hash, with the number of parts mixed in, and the hash of the one before it (0: none); of its part 64
    parities. place is size, place from 1 and a bit for a set that is too large for the number of parts, side by side.
    """

    def parts(ids: pa.RecordBatch, flat: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        classes, seen = order.value
        row = np.repeat(np.arange(len(n)), n)
        often = np.zeros(len(flat), np.int64)
        if len(classes):
            of = (flat >> 32).astype(np.int32)
            at = np.minimum(np.searchsorted(classes, of), len(classes) - 1)
            often = np.where(classes[at] == of, seen[at], 0)
        m, least, most = 1, 1, PART
        while len(flat) and least <= n.max():
            picked = np.flatnonzero(((n >= least) & (threshold * n - 1e-9 < most))[row])
            h, part = flat[picked], row[picked] * m + ((flat[picked] >> 6) & (m - 1))
            by = np.lexsort((h, often[picked], part))
            h, part = h[by], part[by]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            size = np.diff(np.append(starts, len(part)))
            long = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            of = np.repeat(np.arange(len(starts)), size)
            pos = np.arange(len(h)) - starts[of] + 1
            before = np.where(pos > 1, np.roll(h, 1), 0)
            sketch = np.bitwise_xor.reduceat(np.int64(1) << (h & 63), starts) if len(starts) else size
            kept = np.flatnonzero(pos <= long[of])
            of, doc = of[kept], part[kept] // m
            place = size[of] << 16 | pos[kept] << 1 | (n[doc] >= most)
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays([ids.column(0).take(doc), ids.column(1).take(doc), *(pa.array(x) for x in (h[kept] ^ (m - 1) * 0x9E3779B9, sketch[of], before[kept], place))], names=["id", "k", "h", "sketch", "before", "place"])
            m, least, most = m * 4, most, most * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                lists = some.column(2)
                yield from parts(some, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))

    return run


def _near(hashed: DataFrame, threshold: float, most: int) -> DataFrame:
    """``(a, b)``: pairs of ids of ``hashed(id, k, h)`` whose sets can be as alike as ``threshold``; equal sets, of equal k, are one."""
    order = hashed.sparkSession.sparkContext.broadcast(_order(hashed.select("h").mapInArrow(_repeated, "h int, n long"), most))
    kind = hashed.schema["id"].dataType.simpleString()
    first = hashed.mapInArrow(_prefixes(threshold, order), f"id {kind}, k long, h long, sketch long, before long, place long")
    first = first.repartition("h").groupBy("h", "k").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("sketch", "before", "place")])
    first = first.withColumns({"size": F.shiftright("place", 16), "pos": F.shiftright("place", 1).bitwiseAND(32767), "large": F.col("place").bitwiseAND(1)})
    left, right = (first.select("h", *[F.col(c).alias(c + side) for c in ("id", "size", "pos", "large", "sketch", "before")]) for side in "ab")
    both = threshold / (1 + threshold) * (F.col("sizea") + F.col("sizeb")) - 1e-9  # tokens that the parts must share
    here = F.least("posa", "posb") + F.least(F.col("sizea") - F.col("posa"), F.col("sizeb") - F.col("posb"))
    apart = F.bit_count(F.col("sketcha").bitwiseXOR(F.col("sketchb")))  # at least so many tokens are in one of them only
    new = (F.col("beforea") != F.col("beforeb")) | (F.col("beforea") == 0)  # else the pair met at the token before
    met = left.join(right, "h").filter((F.col("ida") < F.col("idb")) & new & (F.col("largea") + F.col("largeb") < 2) & (here >= both) & (apart <= F.col("sizea") + F.col("sizeb") - 2 * both))
    return met.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose id is not in ``ids``, for a join: one of :data:`MARKS` bits is set for each id."""
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS)) + 1
    found = ids.select(mark.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((MARKS // 32768, 4096), np.uint8)
    for row in found.collect():  # as many rows of 4 KB as there are buckets, at most
        bits[row["at"] - 1] = np.frombuffer(row["bits"], np.uint8)
    bits = rows.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def holds(p: pd.Series) -> pd.Series:
        return pd.Series((bits.value[(p.to_numpy() - 1) >> 3] >> ((p.to_numpy() - 1) & 7) & 1).astype(bool))

    return rows.filter(holds(mark))


def _compare(threshold: float, by: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``(by, a, b, score)`` for the pairs of a cell, whose texts stand beside them."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        lists = pc.split_pattern(texts.column("t").combine_chunks(), " ")
        words = lists.flatten().dictionary_encode().indices.to_numpy()
        n = pc.list_value_length(lists).to_numpy()
        start = np.cumsum(n) - n
        place, group = {i: k for k, i in enumerate(texts.column("id").to_pylist())}, np.array(texts.column(by).to_pylist(), object)
        pairs = pairs.sort_by("a")
        a, b = (np.array([place[i] for i in pairs.column(c).to_pylist()]) for c in "ab")
        held, of, both = np.zeros(words.max() + 1, bool), -1, np.zeros(len(a), np.int64)
        for k, (x, y) in enumerate(zip(a, b)):
            if x != of:
                held[:] = False
                held[words[start[x] : start[x] + n[x]]], of = True, x
            both[k] = np.count_nonzero(held[words[start[y] : start[y] + n[y]]])
        score = both / (n[a] + n[b] - both)
        kept = np.flatnonzero((group[a] == group[b]) & (score >= threshold))
        return pa.table([texts.column(by).take(pa.array(a[kept])), *(pairs.column(c).take(pa.array(kept)) for c in "ab"), pa.array(score[kept])], names=[by, "a", "b", "score"])

    return run


def _alike(docs: DataFrame, near: DataFrame, by: str, threshold: float, block: int, max_rows: int) -> DataFrame:
    """``(by, a, b, score)`` of the pairs ``near(a, b)`` that are as alike as ``threshold``.

    A pair goes with the least id that its first text is near to, and such a group of many texts is dealt into a grid of
    blocks, so that a text is sent once to a cell and not with each of its pairs.
    """
    ends = F.explode(F.array("a", "b")).alias("id")
    hubs = near.select("a", ends).groupBy(F.col("id").alias("a")).agg(F.min("a").alias("hub"))
    pairs = near.join(hubs, "a")
    blocks = pairs.select("hub", ends).distinct().groupBy("hub").agg(F.ceil(F.count("*") / block).alias("n"))
    side = lambda c: F.pmod(F.xxhash64(c), F.col("n"))
    i, j = side("a"), side("b")
    cells = materialise(pairs.join(blocks, "hub").select("hub", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), "a", "b"), "cells")
    places = materialise(cells.select("hub", "i", "j", ends).distinct(), "places")
    ids = materialise(places.select("id").distinct(), "ids")
    if ids.limit(max_rows + 1).count() <= max_rows:
        held = docs.join(F.broadcast(ids), "id", "left_semi")
    else:
        held = _marked(docs, ids)
    texts = held.select(by, "id", F.array_join(T.token_set(F.col("text")), " ").alias("t")).join(places, "id")
    schema = f"{by} {docs.schema[by].dataType.simpleString()}, a {{0}}, b {{0}}, score double".format(docs.schema["id"].dataType.simpleString())
    return cells.groupBy("hub", "i", "j").cogroup(texts.groupBy("hub", "i", "j")).applyInArrow(_compare(threshold, by), schema)


def set_members(rows: DataFrame, by: str, id_col: str, text: str = "text") -> DataFrame:
    """``(by, id, least)`` for every row: the least id of the group's rows with an equal token set. Only hashes of sets are shuffled."""
    t = F.sort_array(T.token_set(F.col(text)))
    keys = rows.select(by, F.col(id_col).alias("id"), F.sha2(F.array_join(t, " "), 256).alias("k"))
    least = keys.groupBy(F.col(by).alias("__by"), F.col("k").alias("__k")).agg(F.min("id").alias("least"))
    return keys.join(least, F.col(by).eqNullSafe(F.col("__by")) & F.col("k").eqNullSafe(F.col("__k"))).select(by, "id", "least")


def jaccard_pairs(rows: DataFrame, by: str, id_col: str, text: str = "text", threshold: float = 0.8, most: int = ORDERED_TOKENS, block: int = BLOCK, max_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: pairs of a group's distinct token sets with a Jaccard index of ``threshold`` or more.

    links is ``(by, a, b, score)`` between the least ids of equal token sets, members are those of :func:`set_members`.
    Sets are dealt into parts of some 16 to 64 tokens by hashes of tokens; two sets as alike as ``threshold`` are so in one
    part at least, as the tokens that they share and those that they do not are summed over the parts. Tokens are put in
    order from the rarest on, those beyond ``most`` by hash, and two parts that are as alike share one of their first
    n - ceil(threshold n) + 1. Only hashes of these are shuffled, with 64 parities of the part: the parts differ by as many tokens as
    parities at least, which leaves next to no pairs but those that are alike, and their texts are compared.
    """
    docs = rows.select(F.col(by), F.col(id_col).alias("id"), F.col(text).alias("text"))
    sets = docs.filter(F.col(by).isNotNull() & F.col("text").isNotNull()).select(by, "id", F.sort_array(T.token_set(F.col("text"))).alias("t"))
    hashed = sets.select("id", F.xxhash64(by, "t").alias("k"), F.transform("t", lambda x: F.xxhash64(x, by)).alias("h"))
    near = materialise(_near(hashed, threshold, most), "near")
    return _alike(docs, near, by, threshold, block, max_rows), set_members(rows, by, id_col, text)
