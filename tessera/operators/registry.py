"""Incremental ingest: what changed, what is stale, what the store holds. All are joins on a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def upsert(store: DataFrame, updates: DataFrame, key: list[str], order: list) -> DataFrame:
    """``store`` with ``updates`` written over it by key; of updates with one key the first in ``order`` wins, as in descending time.

    :class:`tessera.sources.store.KeyedStore` does so in place, partition by partition.
    """
    new = latest(updates, key, order)
    return store.join(new.select(*key), key, "left_anti").unionByName(new.select(*store.columns))


def plan_upsert(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, content_hash, action)``: created, updated or skipped."""
    new = docs.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    old = registry.select("doc_id", F.col("content_hash").alias("old"), F.lit(True).alias("known"))
    action = F.when(F.col("known").isNull(), "created").when(F.col("old") == F.col("content_hash"), "skipped").otherwise("updated")
    return new.join(old, "doc_id", "left").select("doc_id", "content_hash", action.alias("action"))


def apply_upsert(store: DataFrame, plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store without the chunks of changed documents, and with their fresh ones."""
    changed = plan.filter("action <> 'skipped'").select("doc_id")
    return store.join(changed, "doc_id", "left_anti").unionByName(fresh.join(changed, "doc_id", "left_semi"))


def delete_docs(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of documents that are not in ``ids(doc_id)``."""
    return rows.join(ids.select("doc_id"), "doc_id", "left_anti")


def registry(chunks: DataFrame, docs: DataFrame, model: str, ingested_at=None) -> DataFrame:
    """A row for each document: hash, chunk ids in order, their count, and the embedding model."""
    held = chunks.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda s: s.chunk_id).alias("chunk_ids"))
    out = docs.select("doc_id", T.content_hash(F.col("text")).alias("content_hash")).join(held, "doc_id", "left")
    out = out.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>"))).withColumn("chunk_count", F.size("chunk_ids"))
    return out.withColumn("embedding_model", F.lit(model)).withColumn("ingested_at", ingested_at if ingested_at is not None else F.lit(None).cast("timestamp"))


def registry_stats(rows: DataFrame) -> DataFrame:
    """Documents and chunks of a registry; zeros for an empty one."""
    return rows.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"))


def check_index(rows: DataFrame, schema_version: int, model: str, dim: int, collection: str) -> DataFrame:
    """``(field, expected, found)`` for each way in which stored vectors do not fit a manifest."""
    seen = rows.select(
        F.explode(
            F.array(
                F.struct(F.lit("schema_version").alias("field"), F.lit(str(schema_version)).alias("expected"), F.col("schema_version").cast("string").alias("found")),
                F.struct(F.lit("embedding_model").alias("field"), F.lit(model).alias("expected"), F.col("embedding_model").alias("found")),
                F.struct(F.lit("embedding_dim").alias("field"), F.lit(str(dim)).alias("expected"), F.size("embedding").cast("string").alias("found")),
                F.struct(F.lit("collection").alias("field"), F.lit(collection).alias("expected"), F.col("collection").alias("found")),
            )
        ).alias("x")
    ).select("x.*")
    return seen.filter(~F.col("found").eqNullSafe(F.col("expected"))).groupBy("field", "expected", "found").agg(F.count("*").alias("n"))


def manifest_stats(chunks: DataFrame) -> DataFrame:
    """Distinct documents and chunks."""
    return chunks.agg(F.count_distinct("doc_id").alias("doc_count"), F.count("*").alias("chunk_count"))


def force_reingest(rows: DataFrame) -> DataFrame:
    """A registry whose hashes are blank, so that every document counts as updated."""
    return rows.withColumn("content_hash", F.lit(""))


def todo(everything: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return everything.join(done.select(key), key, "left_anti")


def drop_empty_tags(rows: DataFrame, tags: str = "themes") -> DataFrame:
    """Rows with a tag."""
    return rows.filter(F.size(tags) > 0)


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows for each key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def attribution(pages: DataFrame, title: str = "title", url: str = "url") -> DataFrame:
    """``pages`` with the ``line`` that names each one's title and address."""
    return pages.withColumn("line", F.format_string("%s | %s", title, url))
