"""Top-k by shared tokens from posting lists with exact score bounds.

Chunks are inverted once, for the tokens that any query has, however many queries there are. A query's rarest tokens
lead to a first few chunks, which are scored in full: the k-th best of them bounds what a chunk must share. With a
bound of s of n tokens a chunk has one of the n - s + 1 rarest of them at least, so that only their lists are read; the
lists of frequent words are not. What is found there is scored in full, from the tokens of a chunk that are asked for.

Queries whose lists hold a large share of all chunks even so are left to the caller's other way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.retrieve import topk
from tessera.session import join_checked, materialise

#: Postings that a query's first look reads at most.
SEED_ROWS = 2_000
#: A query whose lists hold more than this share of the chunks is a dense one.
DENSE = 0.25


def _scored(kind: str, pairs: DataFrame, asked: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(query_id, owner, score, shared)``: pairs of a query and a chunk scored in full, the best chunk of an owner."""
    met = pairs.join(profiles, "uid").join(asked.select("query_id", "terms", "n_query"), "query_id")
    met = met.withColumn("shared", F.size(F.array_intersect("terms", "chunk_terms")))
    over = F.col("n_query") + 1 if kind == "keyword" else F.col("n_query") + F.col("n") - F.col("shared")
    met = met.select("query_id", "owner", (F.col("shared") / over).alias("score"), "shared")
    return met.groupBy("query_id", "owner").agg(F.max("score").alias("score"), F.max("shared").alias("shared"))


def posting_topk(kind: str, queries: DataFrame, chunks: DataFrame, k: int, owner: str, where: list[str], dense_way: Callable[[DataFrame], DataFrame], seed_rows: int = SEED_ROWS, dense: float = DENSE) -> DataFrame:
    """``(query_id, owner, score)``, k rows a query, of ``queries(query_id, where, query_tokens)`` and ``chunks(owner, where, row_tokens)``.

    ``kind`` is keyword (shared tokens over query tokens plus one) or jaccard; higher scores first, ties by owner.
    Owners that share nothing follow with score 0, the least first. ``dense_way`` gives the same for queries whose posting
    lists hold more than ``dense`` of the chunks.
    """
    group = F.struct(*where) if where else F.lit(0)
    none = F.array().cast("array<string>")
    asked = materialise(queries.select("query_id", group.alias("g"), F.coalesce("query_tokens", none).alias("tokens")), "asked")
    words = materialise(asked.select(F.explode("tokens").alias("token")).distinct().withColumn("term", F.monotonically_increasing_id()), "words")
    held = chunks.filter(F.col(owner).isNotNull()).select(F.col(owner).alias("owner"), group.alias("g"), F.coalesce("row_tokens", none).alias("tokens"))
    held = held.withColumn("uid", F.monotonically_increasing_id()).select("uid", "owner", "g", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    postings = materialise(join_checked(held, words, "token").select("uid", "owner", "g", "n", "term"), "postings")
    profiles = materialise(postings.groupBy("uid", "owner", "n").agg(F.collect_list("term").alias("chunk_terms")), "profiles")
    lists = materialise(postings.groupBy("g", "term").agg(F.count("*").alias("df")), "lists")

    terms = asked.select("query_id", "g", F.explode("tokens").alias("token")).join(words, "token").join(lists, ["g", "term"])
    by_df = W.partitionBy("query_id").orderBy("df", "term")
    terms = terms.select("query_id", "g", "term", "df", F.row_number().over(by_df).alias("pos"), F.sum("df").over(by_df).alias("read"))
    terms = materialise(terms, "query_terms")
    known = terms.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    known = materialise(asked.select("query_id", "g", F.size("tokens").alias("n_query")).join(known, "query_id"), "known")

    def met(some: DataFrame) -> DataFrame:
        return some.select("query_id", "g", "term").join(postings.select("uid", "g", "term"), ["g", "term"]).select("query_id", "uid").distinct()

    first = _scored(kind, met(terms.filter(F.col("read") <= seed_rows)), known, profiles)
    least = topk(first, k, order=("owner",)).filter(F.col("rank") == k).select("query_id", "score", F.col("shared").alias("least"))
    if kind == "jaccard":  # a chunk has as many tokens as it shares at least
        least = least.join(known.select("query_id", "n_query"), "query_id").withColumn("least", F.ceil(F.col("score") * F.col("n_query") - 1e-9))
    bound = known.select("query_id", F.size("terms").alias("present")).join(least.select("query_id", "least"), "query_id", "left")
    bound = bound.select("query_id", (F.col("present") - F.greatest(F.coalesce("least", F.lit(1)), F.lit(1)) + 1).alias("rarest"))
    prefix = materialise(terms.join(bound, "query_id").filter(F.col("pos") <= F.col("rarest")), "prefixes")
    sizes = chunks.groupBy(group.alias("g")).agg(F.count("*").alias("rows"))
    cost = prefix.groupBy("query_id", "g").agg(F.sum("df").alias("cost")).join(sizes, "g")
    hard = materialise(cost.filter(F.col("cost") > F.greatest(F.lit(seed_rows), dense * F.col("rows"))).select("query_id"), "dense")

    found = _scored(kind, met(prefix.join(hard, "query_id", "left_anti")), known, profiles)
    best = materialise(topk(found, k, order=("owner",)).select("query_id", "owner", "score"), "best")
    short = asked.select("query_id", "g").join(hard, "query_id", "left_anti").join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    short = short.withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < k)
    # Of the first 2k owners k at least are not among fewer than k found ones.
    rank = F.row_number().over(W.partitionBy("g").orderBy("owner"))
    spare = chunks.filter(F.col(owner).isNotNull()).select(group.alias("g"), F.col(owner).alias("owner")).distinct().withColumn("r", rank).filter(F.col("r") <= 2 * k).drop("r")
    rest = short.join(spare, "g").join(best, ["query_id", "owner"], "left_anti")
    rest = rest.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("owner"))).filter(F.col("r") <= k - F.col("n"))
    out = best.union(rest.select("query_id", "owner", F.lit(0.0).alias("score"))).withColumnRenamed("owner", owner)
    if hard.isEmpty():
        return out
    return out.unionByName(dense_way(join_checked(queries, hard, "query_id", "left_semi")))
