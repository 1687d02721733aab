"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most three of 64 bits agree in one half up to one bit. Each 32-bit half is
covered by a code of radius one: the perfect Hamming code of length 31 and one free bit. A fingerprint is at
home at the anchor next to its half, and is replicated to every anchor within radius plus threshold (two bits,
at most 17 anchors a half). Two halves that differ in one bit meet at the home anchor of either, so comparing
homes with members anchor by anchor finds every pair. Anchors with many homes are compared in a grid of
bounded blocks, and a block sends out a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import connected_components
from tessera.llm.memory import fresh, map_batches
from tessera.session import discard, join_checked, materialise

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Homes of one anchor that one task compares at a time, and how many members it compares them with for each.
BLOCK, MEMBERS = 1024, 16

_STEP = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    stops = ends[width - 1 :].tolist()
    for at in range(0, n, _STEP):
        hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at : at + _STEP], stops[at : at + _STEP])], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(2)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["id", "text_key", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, fp)`` for each row of ``docs``; fp holds the 64 bits as a signed long, text_key a hash of the text."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return map_batches(slim, _fingerprint_batches, "id long, text_key long, fp long")


def _rooted(rows: DataFrame, threshold: int) -> DataFrame:
    """``(fp, root)``: one fingerprint of the component of each of the fingerprints of ``rows``."""
    prints = rows.select("fp").distinct()
    roots = connected_components(links(prints, threshold))
    return prints.join(roots, prints.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _flips() -> list[list[int]]:
    """For each syndrome of the Hamming code, the bit masks that lead from a word to the codewords within two bits."""
    bit = lambda i: 1 << (i - 1)
    return [[0] if s == 0 else [bit(s)] + [bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(32)]


def anchors(prints: DataFrame) -> DataFrame:
    """``(anchor, fp, home)``: every anchor to which a fingerprint belongs; home marks the nearest of each half."""
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for masks in _flips()])
    parts = []
    for half in (0, 1):
        word = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit((1 << 32) - 1))
        low = word.bitwiseAND(F.lit((1 << 31) - 1))
        syndrome = sum(
            (F.bit_count(low.bitwiseAND(F.lit(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)).cast("long"))) % 2) * (1 << k)
            for k in range(5)
        )
        masks = F.get(flips, syndrome.cast("int"))
        near = F.get(masks, F.lit(0))
        free = F.lit(1 << 31).cast("long")
        places = F.concat(masks, F.array(near.bitwiseXOR(free)))
        parts.append(F.struct(F.lit(half).alias("half"), word.alias("word"), places.alias("places")))
    rows = prints.select("fp", F.explode(F.array(*parts)).alias("p"))
    rows = rows.select("fp", "p.half", "p.word", F.posexplode("p.places").alias("k", "mask"))
    anchor = F.col("word").bitwiseXOR(F.col("mask")) + F.col("half").cast("long") * (1 << 32)
    return rows.select(anchor.alias("anchor"), "fp", (F.col("k") == 0).alias("home"))


def _forest(homes: np.ndarray, members: np.ndarray, threshold: int) -> tuple[list, list]:
    """Links between homes and members that join all that are connected by such links."""
    parent = list(range(len(homes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(homes)))
    for at in range(0, len(members), step):
        block = members[at : at + step]
        member, home = np.nonzero(np.bitwise_count(block[:, None] ^ homes[None, :]) <= threshold)
        bounds = np.flatnonzero(np.diff(member, prepend=-1))
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(member)]):
            value, seen = block[member[a]], set()
            for h in home[a:b].tolist():
                r = root(h)
                if r not in seen:
                    seen.add(r)
                    if homes[h] != value:
                        left.append(int(value))
                        right.append(int(homes[h]))
            first = min(seen)
            for r in seen:
                parent[r] = first
    return left, right


def _link_batches(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def links(cols: list[np.ndarray]) -> pa.RecordBatch:
            left, right = [], []
            if len(cols[0]):
                new = np.ones(len(cols[0]), bool)
                new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
                start = np.flatnonzero(new)
                stop = np.append(start[1:], len(new))
                homes = np.add.reduceat(cols[4].astype(np.int64), start)
                for a, b in zip(*(x[(homes > 0) & (stop - start > 1)].tolist() for x in (start, stop))):
                    fp, home = cols[3][a:b].view(np.uint64), cols[4][a:b]
                    u, v = _forest(np.unique(fp[home]), np.unique(fp), threshold)
                    left += u
                    right += v
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], names=["u", "v"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = last[-1] + 1 if len(last) else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield links([c[:cut] for c in cols])
        if rest:
            yield links(rest)

    return run


def links(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(u, v)``: links between the distinct fingerprints of ``prints(fp)``, as many as connect all linked ones."""
    rows = anchors(prints)
    sizes = rows.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count("*").alias("members")).filter((F.col("homes") > block) | (F.col("members") > MEMBERS * block))
    cells = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("int").alias(n)
    hot = materialise(sizes.select("anchor", cells("homes", block), cells("members", MEMBERS * block)), "hot")
    if hot.isEmpty():
        rows = rows.select("anchor", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp", "home")
    else:
        one = F.lit(1)
        rows = rows.join(hot, "anchor", "left").withColumns({c: F.coalesce(c, one) for c in ("homes", "members")})
        own = lambda m: F.pmod(F.xxhash64("fp"), F.col(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        homes = rows.filter("home").select("anchor", own("homes").alias("a"), every("members").alias("b"), "fp", "home")
        members = rows.select("anchor", every("homes").alias("a"), own("members").alias("b"), "fp", F.lit(False).alias("home"))
        rows = homes.union(members)
    dealt = rows.repartition("anchor", "a", "b").sortWithinPartitions("anchor", "a", "b")
    return map_batches(dealt, _link_batches(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``.

    A component holds all rows that chains of links of at most ``threshold`` differing bits (three at most)
    connect; its name is its least id. Null and wordless texts have fingerprint zero and link like others. Rows
    with a null id take part; they name a component only by null, if no row of it has an id. Repeated rows are
    returned as often as they come, ties do not matter, an empty table gives an empty result, and further
    columns of ``docs`` are not looked at.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors cover {THRESHOLD} differing bits at most")
    rows = materialise(with_fingerprints(docs, id_col, text_col), "fingerprints")
    named = rows.groupBy("fp").agg(F.min("id").alias("least")).join(_rooted(rows, threshold), "fp")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: F.Column) -> F.Column:
    """The 16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: the one with the least id, and of those the least hash of the text.

    A row is known by its id and its text together: rows of one id whose texts are unlike are documents of their own.
    A null id counts as a negative number made from the text. Of repeated rows with one id and text one stays.
    Null and wordless texts are copies of one another. Columns may have any name; an empty table stays empty.
    The rows to drop are broadcast if they are at most ``max_broadcast`` (counted); else the join shuffles.
    """
    key = fresh(docs.columns, "row_key")
    text_key = fresh([*docs.columns, key], "text_key")
    number = F.coalesce(F.col(id_col).cast("long"), -F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 1) - 1)
    keyed = docs.withColumn(key, number).withColumn(text_key, F.xxhash64(F.col(text_col)))
    prints = materialise(with_fingerprints(keyed, key, text_col), "fingerprints")
    rows = prints.groupBy("id", "text_key", "fp").agg(F.count("*").alias("n")).join(_rooted(prints, THRESHOLD), "fp")
    rows = materialise(rows.select("id", "text_key", "root", "n"), "components")
    first = rows.groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("first"))
    judged = rows.join(first, "root").withColumn("stays", F.struct("id", "text_key") == F.col("first"))
    both = [F.col("id").alias(key), F.col("text_key").alias(text_key)]
    dropped = materialise(judged.filter(~F.col("stays")).select(*both), "dropped")
    small = dropped.count() <= max_broadcast
    kept = keyed.join(F.broadcast(dropped) if small else dropped, [key, text_key], "left_anti")
    twice = materialise(judged.filter(F.col("stays") & (F.col("n") > 1)).select(*both), "twice")
    if not twice.isEmpty():
        single = join_checked(kept, twice, [key, text_key], "left_anti")
        kept = single.unionByName(join_checked(kept, twice, [key, text_key], "left_semi").dropDuplicates([key, text_key]))
    discard(prints)
    discard(rows)
    return kept.select(*docs.columns)
