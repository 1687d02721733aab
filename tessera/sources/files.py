"""Sources and sinks: tagged text, raw pages, chunk files, collections and evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "slug string, title string, canonical_url string, license string, wikitext string"
CHUNK_SCHEMA = "chunk_id string, character string, section_path array<string>, text string, word_count int, themes array<string>, source_url string, source_license string"


def read_tagged_text(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)`` of files in which a line ``doc_id: X`` opens a document; one without a body is dropped.

    Records are cut at the header, so that large files are split.
    """
    raw = spark.read.option("lineSep", "\ndoc_id:").text(path)
    record = F.regexp_replace("value", r"^\s*doc_id:", "")
    head = F.trim(F.get(F.split(record, "\n", 2), F.lit(0)))
    body = F.regexp_replace(F.coalesce(F.get(F.split(record, "\n", 2), F.lit(1)), F.lit("")), r"^\s+|\s+$", "")
    return raw.select(head.alias("doc_id"), body.alias("text")).filter("text <> '' and doc_id <> ''")


def write_tagged_text(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Documents ``(doc_id, text)`` as tagged text; those without an id or a text are left out, as they would be on reading."""
    docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.format_string("doc_id: %s\n%s\n", F.col("doc_id").cast("string"), F.col("text"))).write.mode(mode).text(path)


def read_pages(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, lines: bool = False) -> DataFrame:
    """Raw pages, one JSON object a file; with ``lines`` one a line, so that many pages share a file and large files are split."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_pages(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Raw pages as JSON lines, about a file for each task: a file of its own for each page costs more than the page."""
    pages.write.mode(mode).json(path)


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Chunks, one JSON object a line."""
    return spark.read.schema(schema).json(path)


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks as JSON lines."""
    chunks.write.mode(mode).json(path)


def overwrite_collection(chunks: DataFrame, path: str) -> None:
    """Replace the collections that ``chunks`` has rows of, and leave others alone."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def write_eval(rows: DataFrame, path: str) -> DataFrame:
    """Write rows of an evaluation as JSON lines and return them read back, to be aggregated."""
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def count_stored(chunks: DataFrame) -> DataFrame:
    """Number of stored chunks."""
    return chunks.agg(F.count("*").alias("chunks"))
