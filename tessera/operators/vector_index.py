"""Approximate vector search by an inverted file: cells of a coarse quantiser, and residuals as product codes.

The quantisers are learned from a bounded sample, the index holds every vector. A search touches the lists of the
cells next to a query only. It scans codes, a byte for each piece of a vector, and scores exactly what looks best, so
that whole vectors meet queries for a small share of all pairs. :func:`tessera.operators.retrieve.vector_topk` is the
exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieve import BLOCK_ROWS, PART_ROWS, topk
from tessera.session import join_checked, materialise

#: Cells of the coarse quantiser at most; rows of the sample that it is learned from; rounds of learning.
CELLS, SAMPLE, ROUNDS = 4096, 20_000, 12
#: Values of a code.
CODES = 256


@dataclass
class VectorIndex:
    """Cells, code books ``[piece, code, :]`` of the residuals, and two written tables: lists of codes by cell, and unit vectors."""

    cells: np.ndarray
    books: np.ndarray
    lists: DataFrame  # cell, part, vec_id, code
    vectors: DataFrame  # vec_id, v
    parts: DataFrame  # cell, parts: into how many parts a cell's list is dealt
    rows: int


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers as unit vectors; a null or empty one, or one of zeros, is all zeros."""
    out = np.zeros((len(column), width), np.float32)
    for i, row in enumerate(column.to_pylist()):
        if row:
            own = np.array([x or 0.0 for x in row[:width]], np.float32)
            out[i, : len(own)] = own / (np.linalg.norm(own) + 1e-9)
    return out


def _kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``k`` centres of ``rows`` by Lloyd's rounds from distinct rows; an empty cell starts anew at the row worst placed."""
    first = np.unique(rows, axis=0)
    centres = first[rng.choice(len(first), min(k, len(first)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        far = (centres**2).sum(1) - 2 * rows @ centres.T
        own, worst = far.argmin(1), far.min(1) + (rows**2).sum(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        centres = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = rows[np.argsort(-worst)[: len(empty)]]
    return centres.astype(np.float32)


def _nearest_cell(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def build(vectors: DataFrame, cells: int = 64, pieces: int = 16, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, rounds: int = ROUNDS, part_rows: int = PART_ROWS, seed: int = 7) -> VectorIndex:
    """The index of all ``vectors``; the quantisers are learned from ``sample`` of them, those of the least hash of the id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("e"))
    taught = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    width = max((len(x) for x in taught["e"].to_pylist() if x), default=1)
    width += -width % pieces
    known, rng = _unit(taught["e"].combine_chunks(), width) if len(taught) else np.zeros((1, width), np.float32), np.random.default_rng(seed)
    centres = _kmeans(known, min(cells, CELLS), rounds, rng)
    residuals = known - centres[_nearest_cell(known, centres)]
    size = width // pieces
    books = np.zeros((pieces, CODES, size), np.float32)
    for j in range(pieces):
        own = _kmeans(residuals[:, j * size : (j + 1) * size], CODES, rounds, rng)
        books[j] = np.concatenate([own, np.repeat(own[:1], CODES - len(own), 0)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1), width)
            cell = _nearest_cell(unit, centres)
            rest = unit - centres[cell]
            codes = np.stack([_nearest_cell(rest[:, j * size : (j + 1) * size], books[j]) for j in range(pieces)], 1).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, width), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), lists], names=["cell", "vec_id", "code", "v"])

    held = materialise(rows.mapInArrow(coded, "cell int, vec_id long, code binary, v array<float>"), "coded")
    parts = held.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    parts = materialise(parts, "cells")  # a row a cell, bounded by CELLS
    dealt = held.select("cell", "vec_id", "code").join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    lists = materialise(dealt.select("cell", "part", "vec_id", "code").repartitionByRange("cell", "part").sortWithinPartitions("cell", "part"), "lists")
    return VectorIndex(centres, books, lists, held.select("vec_id", "v"), parts, held.count())


def _scan(books: np.ndarray, keep: int):
    """The ``keep`` rows of a list that look best for each of a block of queries, by codes."""

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        names = rows["vec_id"].to_numpy()
        if not len(block) or not len(rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "guess": pa.array([], pa.float32())})
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
        asked = np.array(block["q"].to_pylist(), np.float32)
        pieces, size = books.shape[0], books.shape[2]
        guess = np.repeat(block["near"].to_numpy()[:, None], len(rows), 1).astype(np.float32)  # the product with the cell's centre
        for j in range(pieces):
            guess += (asked[:, j * size : (j + 1) * size] @ books[j].T)[:, codes[:, j]]
        most = min(keep, len(rows))
        best = np.argpartition(-guess, most - 1, axis=1)[:, :most]
        return pa.table({"query_id": block["query_id"].take(pa.array(np.repeat(np.arange(len(block)), most))), "vec_id": pa.array(names[best.ravel()]), "guess": pa.array(np.take_along_axis(guess, best, 1).ravel())})

    return run


def candidates(index: VectorIndex, queries: DataFrame, probes: int, keep: int, query_id: str = "query_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, vec_id, q)``: the ``keep`` vectors that look best by their codes in the ``probes`` cells next to each query."""
    centres, width = index.cells, index.cells.shape[1]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1), width)
            near = unit @ centres.T
            cells = np.argsort((centres**2).sum(1) - 2 * near, axis=1, kind="stable")[:, :probes]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, width), pa.int32()), pa.array(unit.ravel()))
            pairs = [[{"cell": int(c), "near": float(near[i, c])} for c in row] for i, row in enumerate(cells)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(pairs, pa.list_(pa.struct([("cell", pa.int32()), ("near", pa.float32())])))], names=["query_id", "q", "cells"])

    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(embedding).cast("array<float>").alias("e"))
    asked = materialise(asked.mapInArrow(probed, "query_id long, q array<float>, cells array<struct<cell: int, near: float>>"), "probes")
    blocks = max(1, -(-asked.count() // block_rows))
    left = asked.select("query_id", "q", F.explode("cells").alias("c")).select("query_id", "q", "c.cell", "c.near").join(F.broadcast(index.parts), "cell")
    left = left.select("query_id", "q", "cell", "near", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    right = index.lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["cell", "part", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(index.books, keep), "query_id long, vec_id long, guess float")
    found = topk(met, keep, by="guess", order=("vec_id",)).select("query_id", "vec_id")
    return found.join(asked.select("query_id", "q"), "query_id")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, rerank: int = 10, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, vec_id, score, rank)``: nearest vectors by cosine among the ``rerank`` times k that look best; ties by id.

    Null and empty vectors are vectors of zeros. Queries with one id count as one. A query gets fewer than k rows only
    where its cells hold fewer vectors.
    """
    asked = queries.dropDuplicates([query_id])
    met = join_checked(index.vectors, materialise(candidates(index, asked, probes, rerank * k, query_id, embedding), "candidates"), "vec_id")
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return topk(met.select("query_id", "vec_id", dot.alias("score")), k, order=("vec_id",))
