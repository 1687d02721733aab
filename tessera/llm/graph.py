"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the least node of the component.

    Each round reads and writes only the edge table, which never grows, in the shared folder. Edges with
    a null end and loops are left out. Raises if ``max_rounds`` do not suffice (2^60 nodes would).
    """
    current = materialise(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = _digest(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last, current = current, materialise(_small_star(_large_star(current)), "edges")
        discard(last)
        after = _digest(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
