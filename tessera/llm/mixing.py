"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source the keys are sorted by range: the leading bits of a key
name one of many equal ranges, so that a source of any size is spread over tasks. Prefix sums of sizes run
first over the ranges and then within each range, and the mix is cut at each source's exact budget. A source
whose target exceeds its size is repeated whole, and then cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialise

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times its source's size.
MOST = 3
#: Documents that one range of keys holds on average.
RANGE_ROWS = 4_000

_KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(id_col: Column, text: Column) -> Column:
    """60 bits of the md5 of the id and the text."""
    word = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(word), 1, _KEY_BITS // 4), 16, 10).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums over those before each one in ``order``, by name; ``order`` tells all rows apart.

    Rows are dealt out by ranges; sums go over the ranges, one row each, and then within each range.
    """
    names = list(sums)
    ranged = materialise(rows.withColumns({f"own_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    before = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    marks = ranged.groupBy("range_").agg(*[F.sum(f"own_{n}").alias(f"all_{n}") for n in names])
    marks = marks.select("range_", *[F.coalesce(F.sum(f"all_{n}").over(before), F.lit(0)).alias(f"start_{n}") for n in names])
    within = W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(marks, "range_").withColumns({n: F.col(f"start_{n}") + F.coalesce(F.sum(f"own_{n}").over(within), F.lit(0)) for n in names})
    return out.drop("range_", *[f"{k}_{n}" for k in ("own", "start") for n in names])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size, ...)`` with ``target``: shares of the total by weight, stopped at ``most`` times the size.

    What is above a stop is shared anew by weight among the rest until none is above; that is one level for
    all sources not stopped, found from running sums in the order of stop over weight. One row a source.
    """
    by_name = F.col("source").asc_nulls_last()
    rows = running(sizes, [by_name], {"place": F.lit(1).cast("long")})
    rows = rows.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))).drop("place")
    rows = rows.withColumn("stop", (F.col("source_size") * most).cast("double") / F.col("w"))
    rows = running(rows, [F.col("stop").asc(), by_name], {"size_before": F.col("source_size"), "w_before": F.col("w").cast("long")})
    total = rows.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w_total"))
    level = (F.col("total") - most * F.col("size_before")) / (F.col("w_total") - F.col("w_before"))
    rows = materialise(rows.join(F.broadcast(total), F.lit(True)).withColumn("level", level).drop("size_before", "w_before", "total", "w_total"), "levels")  # one row is broadcast
    found = rows.agg(F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).alias("found"))
    rows = rows.drop("level").join(F.broadcast(found), F.lit(True))
    share = F.when(F.col("stop") <= F.coalesce("found", F.col("stop")), F.col("source_size") * F.lit(float(most))).otherwise(F.col("found") * F.col("w"))
    return rows.withColumn("target", share).drop("w", "stop", "found")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source)`` for every row of ``docs``.

    taken is the number of words that the mix takes from the document, epochs added up; the document at the cut
    gives a part, so that a source's taken words are its target without the fraction. A null text has size 0; a
    null source is a source of its own, last in order; a null id is hashed as the empty string; equal keys are
    taken in order of size, and rows alike in all that is returned are interchangeable. An empty table gives an
    empty result. No task sorts a whole table, that of the sources included.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            random_key(F.col(id_col), F.col(text_col)).alias("key"),
        ),
        "sizes",
    )
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    sizes = materialise(sizes.withColumn("ranges", F.ceil(F.col("n") / range_rows)).drop("n"), "targets").withColumnRenamed("source", "s")
    joined = rows.join(sizes, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    half = _KEY_BITS // 2
    ranged = joined.withColumn("range", F.floor(F.shiftright("key", half) * F.col("ranges") / F.lit(float(1 << half))).cast("long"))
    marks = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    up_to = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    marks = marks.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("range_start"))
    placed = ranged.join(marks, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    within = W.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    return placed.withColumn("taken", taken).select("doc_id", "size", "source_size", "target", "taken", "source")


#: The same mix in SQL.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, (source_size * 3)::DOUBLE / w AS stop,
             sum(source_size) OVER () AS total, sum(w) OVER () AS w_total,
             coalesce(sum(source_size) OVER b, 0) AS s_before, coalesce(sum(w) OVER b, 0) AS w_before
      FROM w WINDOW b AS (ORDER BY (source_size * 3)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - 3 * s_before)::DOUBLE / (w_total - w_before)::DOUBLE AS level FROM o),
m AS (SELECT *, max(CASE WHEN level <= stop THEN level END) OVER () AS lv FROM l),
t AS (SELECT source, source_size, CASE WHEN stop <= coalesce(lv, stop) THEN source_size * 3.0::DOUBLE ELSE lv * w END AS target FROM m),
p AS (SELECT d.*, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * source_size - start)))::BIGINT AS taken, source
FROM q
"""
