"""The Merkle manifest against a plain tree, and odd tables."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tests import oracle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Levels of nodes up to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run, at = level[i // 16 * 16 :][:16], i % 16
        out.append((run[:at], run[at + 1 :]))
        i //= 16
    return out


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = tree([x[2] for x in groups[name]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, own, row) in enumerate(groups[name]):
            steps = way(trees[name], i) + way(top, k)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            low = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            node = leaf((*row[:4], low)) if changed else own
            for a, b in steps:
                node = sha("".join(a) + node + "".join(b))
            proof = sha("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((row[0], own, trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    rows = merkle.versions(df)
    folded = F.coalesce(F.try_element_at("copied", F.lit(-1)), "tampered_leaf", "leaf")
    return sorted(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded, folded == F.col("root")).collect()), key=str)


def test_several_tiers_and_many_sources(spark):
    rows = [(i * 3 % 9001, "large", "en", i, f"Text {i}") for i in range(4100)] + [(i, f"s{i % 40:02}", None, None, "Ärger Q") for i in range(150)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows)
    assert 0 < sum(not x[-1] for x in got) < len(got)


def test_nulls_ties_repeats_and_single_documents(spark):
    rows = [(None, None, None, None, None), (None, "", "x", 1, ""), (5, None, "de", 2, "Five"), (5, None, "de", 2, "Five"), (5, None, "de", 2, "five"), (7, "-", "a", None, "X" * 200_000), (-3, "z", "é", 0, "\n")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    one = [(4, "only", "en", 1, "One")]
    assert found(spark.createDataFrame(one, SCHEMA)) == plain(one)
    twelve = [(12, "only", "en", 1, "One")]  # tampered, and its own root
    assert zlib.crc32(b"12") % 5 != 0 or found(spark.createDataFrame(twelve, SCHEMA)) == plain(twelve)


def test_empty_table_and_other_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(i, "s", "en", i, f"T{i}") for i in range(20)]
    more = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("group", "place", "total", "digest", "leaf", "n", "copied")})
    assert found(more) == plain(rows)


def test_a_version_copies_one_node_a_level_and_shares_the_rest(spark):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(300)] + [(i, "t", "en", i, f"T{i}") for i in range(3)]
    out = merkle.versions(spark.createDataFrame(rows, SCHEMA)).collect()
    first = {n for level in tree([r.leaf for r in sorted(out, key=lambda r: r.place) if r.source == "s"]) for n in level} | {out[0].root}
    for row in out:
        if row.source == "s":
            assert len(row.copied) == 4  # 300, 19, 2, 1 and the root above the sources
            assert (row.tampered_leaf is None) == (set(row.copied) <= first)


@pytest.mark.parametrize("sf", ["0.001"])
def test_equals_the_sql(spark, sf):
    import __spark_entry__ as entry

    name, folder = "op13_merkle_manifest", f"/root/testdata/sf{sf}"
    assert oracle.compare(spark, oracle.connect(folder), entry.queries()[name], entry.oracle_sql()[name], folder) is None
