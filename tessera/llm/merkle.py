"""A Merkle manifest of a dataset as a persistent tree whose versions copy paths.

Leaves are dealt into aligned blocks of 16^3 consecutive ones of a source, so that three levels of the tree lie within
a block and one task builds them. What a block leaves over, one node, is a leaf of the upper tree of the source, dealt
into blocks likewise, tier by tier; the sources' roots have a tree of their own. A tampered leaf makes a version of the
tree that shares every node with the first one but the leaf's ancestors, of which it has copies: those of its block are
made beside the block's nodes, and the version goes on through the tiers above along the siblings that were handed
down to the block. So a version costs one node a level, however large the dataset.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.chars import ascii_lower
from tessera.session import discard, join_checked, materialise, ship

#: Nodes of a run that become one; levels of the tree within a block.
FAN, LEVELS = 16, 3
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_BLOCK = FAN**LEVELS
_NODES = "group string, place long, total long, digest string"
_PATHS = "group string, place long, lefts array<string>, rights array<string>"


def _encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*[_encoded(c) for c in columns]), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row is one of those that are tampered with; rows without an id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` within ``group`` (from 0) in ``order`` and the group's ``total``.

    Rows are sorted by ranges over all groups, so that a large group is spread over many tasks; places within a range
    are then shifted by the counts of the ranges before.
    """
    sorted_rows = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    numbered = materialise(sorted_rows.withColumn("row_", F.monotonically_increasing_id()).withColumn("range_", F.spark_partition_id()), "ranked")
    marks = numbered.groupBy(group, "range_").agg(F.count("*").alias("n_"), F.min("row_").alias("first_"))
    before = W.partitionBy(group).orderBy("range_")
    starts = F.coalesce(F.sum("n_").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_").over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    marks = materialise(marks.select(group, "range_", "first_", starts.alias("start_"), total.alias("total")), "marks")
    out = join_checked(numbered, marks, [group, "range_"])
    return out.withColumn("place", F.col("start_") + F.col("row_") - F.col("first_")).drop("row_", "range_", "first_", "start_")


def _digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def _depth(total: int) -> int:
    """Levels of a block's tree: until one node is left, three at most."""
    depth = 0
    while total > 1 and depth < LEVELS:
        total, depth = -(-total // FAN), depth + 1
    return depth


def _nodes(leaves: list[str], depth: int) -> list[list[str]]:
    """The nodes of a block level by level, the leaves first."""
    levels = [leaves]
    for _ in range(depth):
        last = levels[-1]
        levels.append([_digest("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """What stands left and right of leaf ``i`` and of its ancestors within their runs, level by level."""
    lefts, rights = [], []
    for level in levels[:-1]:
        first = i - i % FAN
        lefts.append("".join(level[first:i]))
        rights.append("".join(level[i + 1 : first + FAN]))
        i //= FAN
    return lefts, rights


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _block_roots(table: pa.Table) -> pa.Table:
    """The one node that is left of a block, as a leaf of the tier above."""
    table = _ordered(table)
    total, place = table["total"][0].as_py(), table["place"][0].as_py()
    root = _nodes(table["digest"].to_pylist(), _depth(total))[-1]
    return pa.table({"group": table["group"].slice(0, 1), "place": pa.array([place // _BLOCK]), "total": pa.array([-(-total // _BLOCK)]), "digest": pa.array(root)})


def _block_paths(table: pa.Table, above: pa.Table) -> pa.Table:
    """Of every node of a block the siblings on its way to the top, those above the block included."""
    table = _ordered(table)
    levels = _nodes(table["digest"].to_pylist(), _depth(table["total"][0].as_py()))
    over = above["lefts"][0].as_py(), above["rights"][0].as_py()
    both = [_siblings(levels, i) for i in range(len(table))]
    return pa.table({"group": table["group"], "place": table["place"], "lefts": pa.array([x[0] + over[0] for x in both], pa.list_(pa.string())), "rights": pa.array([x[1] + over[1] for x in both], pa.list_(pa.string()))})


def _block_versions(table: pa.Table, above: pa.Table) -> pa.Table:
    """Of every leaf of a block its version: the copies of its ancestors, from the lowest one to the root."""
    table = _ordered(table)
    leaves, new = table["digest"].to_pylist(), table["tampered_leaf"].to_pylist()
    levels = _nodes(leaves, _depth(table["total"][0].as_py()))
    over = above["lefts"][0].as_py(), above["rights"][0].as_py()
    proofs, copies = [], []
    for i, (leaf, other) in enumerate(zip(leaves, new)):
        own = _siblings(levels, i)
        lefts, rights = own[0] + over[0], own[1] + over[1]
        proofs.append(_digest("".join(a + b for a, b in zip(lefts, rights))))
        node, copied = other or leaf, []
        for a, b in zip(lefts, rights):
            node = _digest(a + node + b)
            copied.append(node)
        copies.append(copied)
    return pa.table({"doc_id": table["doc_id"], "group": table["group"], "place": table["place"], "leaf": table["digest"], "tampered_leaf": table["tampered_leaf"], "proof_sha256": pa.array(proofs, pa.string()), "copied": pa.array(copies, pa.list_(pa.string()))})


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / _BLOCK).cast("long"))


@dataclass
class Tree:
    """The first version of a tree: its nodes tier by tier, the leaves first and last one node for each group; all tables are written."""

    tiers: list[DataFrame] = field(default_factory=list)

    def roots(self) -> DataFrame:
        """``(group, digest)``: the root of each group."""
        return self.tiers[-1].select("group", "digest")

    def paths(self, above: DataFrame, tier: int = 1) -> DataFrame:
        """``(group, place, lefts, rights)``: the siblings of each node of a tier and of its ancestors up to the top.

        ``above`` has such rows for the groups' roots, from which the ways go on. Tier 1 has a node for each block of leaves.
        """
        for nodes in reversed(self.tiers[tier:-1]):
            met = _in_blocks(nodes.select("group", "place", "total", "digest")).groupBy("group", "block").cogroup(above.withColumnRenamed("place", "block").groupBy("group", "block"))
            above = materialise(met.applyInArrow(_block_paths, _PATHS), "paths")
        return above


def build(leaves: DataFrame) -> Tree:
    """The tree of ``leaves(group, place, total, digest, ...)``, which is a written table; tiers go on until each group has one node."""
    tree, nodes = Tree([leaves]), leaves
    while True:
        blocks = _in_blocks(nodes.select("group", "place", "total", "digest"))
        nodes = materialise(blocks.groupBy("group", "block").applyInArrow(_block_roots, _NODES), "nodes")
        tree.tiers.append(nodes)
        if nodes.filter("total > 1").isEmpty():
            return tree


def versions(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, source, place, leaf, tampered_leaf, subroot, root, proof_sha256, copied``.

    ``fields`` names the columns for id, source, language, length and text. ``copied`` are the nodes that the row's
    version of the tree has of its own, from the run of the leaf up to its root; all others are those of the first
    version. Rows that are not tampered with have a null ``tampered_leaf``, and their version is the first one. Leaves
    of one id stand in the order of their digests, those without an id before the others; null sources form a source
    before all others. A null in any field is written ``-``. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in fields)
    other = F.when(tampered(doc_id), leaf_digest([doc_id, source, lang, n_chars, ascii_lower(text)]))
    group = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))  # no source stands before an empty name
    made = docs.select(doc_id.alias("doc_id"), group.alias("group"), leaf_digest([doc_id, source, lang, n_chars, text]).alias("digest"), other.alias("tampered_leaf"))
    made = materialise(made.withColumn("n", F.monotonically_increasing_id()), "leaves")
    leaves = materialise(ranked(made, "group", [F.col("doc_id"), F.col("digest"), F.col("n")]).drop("n"), "leaves")
    discard(made)
    tree = build(leaves)
    sources = materialise(ranked(tree.roots().select(F.lit("").alias("group"), F.col("group").alias("of"), "digest"), "group", [F.col("of")]), "sources")
    top = build(sources)
    none = F.array().cast("array<string>")
    down = top.paths(top.roots().select("group", F.lit(0).cast("long").alias("place"), none.alias("lefts"), none.alias("rights")), 0)
    down = join_checked(sources.select("place", "of"), down.select("place", "lefts", "rights"), "place").select(F.col("of").alias("group"), F.lit(0).cast("long").alias("place"), "lefts", "rights")
    above = tree.paths(materialise(down, "paths"))
    schema = f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, group string, place long, leaf string, tampered_leaf string, proof_sha256 string, copied array<string>"
    met = _in_blocks(leaves).groupBy("group", "block").cogroup(above.withColumnRenamed("place", "block").groupBy("group", "block"))
    out = met.applyInArrow(_block_versions, schema)
    root = top.roots().select(F.col("digest").alias("root"))
    facts = materialise(tree.roots().withColumnRenamed("digest", "subroot").join(F.broadcast(root), F.lit(True)), "subroots")  # one row is broadcast
    named = join_checked(out, facts, "group")
    return named.select("doc_id", F.when(F.col("group") != "", F.substring("group", 2, 1 << 30)).alias("source"), "place", "leaf", "tampered_leaf", "subroot", "root", "proof_sha256", "copied")


def _tree_sql(name: str, start: str, levels: int) -> str:
    """CTEs for the levels of a tree and their runs, from ``start(g, p, n, d)`` on."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT g, p // 16 AS q, max(n) AS n, list(d ORDER BY p) AS ds FROM {name}{k} GROUP BY g, p // 16)")
        out.append(f"{name}{k + 1} AS (SELECT g, q AS p, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {name}r{k})")
    return ",\n".join(out)


def _fold_sql(name: str, rows: str, levels: int) -> tuple[str, str]:
    """CTEs that take ``rows(g, p, ..., fold, proof)`` up the levels of a tree, and the name of the last."""
    out = []
    for k in range(levels):
        place = f"(x.p // {16**k}) % 16"
        left, right = f"array_to_string(r.ds[1:{place}], '')", f"array_to_string(r.ds[{place} + 2:], '')"
        out.append(
            f"{name}f{k} AS (SELECT x.* EXCLUDE (fold, proof), CASE WHEN r.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold, "
            f"CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM {rows} x JOIN {name}r{k} r ON x.g = r.g AND x.p // {16 ** (k + 1)} = r.q)"
        )
        rows = f"{name}f{k}"
    return ",\n".join(out), rows


def versions_sql(levels: int = 6, top_levels: int = 3) -> str:
    """The digest of the same in SQL, for sources of up to 16^levels rows and up to 16^top_levels sources."""
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([enc("doc_id"), enc("source"), enc("lang"), enc("n_chars"), enc(text)]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, t.crcs[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    up, folded = _fold_sql("l", "x0", levels)
    over, ended = _fold_sql("s", "y0", top_levels)
    return f"""
WITH t AS (SELECT list(list_reduce([i] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1))) ORDER BY i) AS crcs FROM range(256) AS r(i)),
d AS (SELECT doc_id, source, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS other FROM {{docs}}, t),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree_sql("l", "SELECT g, p, n, leaf AS d FROM o", levels)},
b AS (SELECT g AS og, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, d FROM l{levels}),
{_tree_sql("s", "SELECT '' AS g, p, n, d FROM b", top_levels)},
x0 AS (SELECT *, coalesce(other, leaf) AS fold, '' AS proof FROM o),
{up},
y0 AS (SELECT f.doc_id, f.leaf, f.fold, f.proof, b.d AS subroot, '' AS g, b.p FROM {folded} f JOIN b ON f.g = b.og),
{over}
SELECT doc_id, leaf, subroot, s{top_levels}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = s{top_levels}.d AS verified FROM {ended}, s{top_levels}
"""
