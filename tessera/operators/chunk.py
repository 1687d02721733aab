"""Chunkers: one document row to many chunk rows, by array expressions and posexplode, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

SIZE, OVERLAP = 300, 50


def _windows(found: Column, size: int, step: int) -> Column:
    starts = F.sequence(F.lit(0), F.size(found) - 1, F.lit(step))
    return F.when(F.size(found) > 0, F.transform(starts, lambda i: F.array_join(F.slice(found, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def fixed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` words that start every ``size - overlap`` words."""
    return T.let(T.words(text), lambda w: _windows(w, size, size - overlap))


def by_sentence(text: Column, most: int = 5) -> Column:
    """Groups of ``most`` sentences; an empty text is one empty chunk."""
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+")
    return T.let(parts, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(most)), lambda i: F.array_join(F.slice(s, i + 1, most), " ")))


def by_paragraph(text: Column, sep: str = r"\n\s*\n") -> Column:
    """Trimmed paragraphs that are not empty."""
    return F.filter(F.transform(F.split(text, sep), T.strip), lambda p: p != "")


def recursive(text: Column, size: int = SIZE, sep: str = r"\n\s*\n") -> Column:
    """Paragraphs; those of more than ``size`` words as fixed windows."""
    return F.flatten(F.transform(by_paragraph(text, sep), lambda p: F.when(T.token_count(p) <= size, F.array(p)).otherwise(fixed(p, size))))


def band(text: Column, low: int = 80, high: int = 150, tail: int = 40) -> Column:
    """Sentences packed into a band of words: flushed before ``high`` is exceeded and from the middle on; a short tail goes."""
    middle = low + (high - low) // 2
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        n = T.token_count(s)
        over = (acc.n > 0) & (acc.n + n > high)
        out = F.when(over, F.concat(acc.out, F.array(acc.buf))).otherwise(acc.out)
        buf = F.when(over | (acc.n == 0), s).otherwise(F.concat_ws(" ", acc.buf, s))
        total = F.when(over, n).otherwise(acc.n + n)
        full = total >= middle
        return F.struct(
            F.when(full, F.concat(out, F.array(buf))).otherwise(out).alias("out"),
            F.when(full, F.lit("")).otherwise(buf).alias("buf"),
            F.when(full, F.lit(0)).otherwise(total).alias("n"),
        )

    return F.aggregate(T.sentences(text), start, step, lambda acc: F.when(acc.n >= tail, F.concat(acc.out, F.array(acc.buf))).otherwise(acc.out))


STRATEGIES = {"fixed": fixed, "sentence": by_sentence, "paragraph": by_paragraph, "recursive": recursive, "band": band}


def build_chunks(docs: DataFrame, strategy: str = "fixed", chunk_type: str = "text", **options) -> DataFrame:
    """``(chunk_id, doc_id, chunk_index, strategy, chunk_type, text)`` with ids made from document, index and strategy."""
    pieces = docs.select("doc_id", F.posexplode(STRATEGIES[strategy](F.col("text"), **options)).alias("chunk_index", "text"))
    name = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.lit(strategy))
    return pieces.select(F.sha2(name, 256).alias("chunk_id"), "doc_id", "chunk_index", F.lit(strategy).alias("strategy"), F.lit(chunk_type).alias("chunk_type"), "text")


def ingest(docs: DataFrame, metadata: dict[str, str] | None = None, strategy: str = "fixed", **options) -> DataFrame:
    """Chunks with shared metadata as a map beside them."""
    pairs = [F.lit(x) for kv in sorted((metadata or {}).items()) for x in kv]
    shared = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return build_chunks(docs, strategy, **options).withColumn("metadata", shared)


def with_chunk_type(chunks: DataFrame, default: str = "text") -> DataFrame:
    """``chunk_type`` from the metadata, else the default."""
    return chunks.withColumn("chunk_type", F.coalesce(F.col("metadata")["chunk_type"], F.lit(default)))


def sweep(docs: DataFrame, options: dict[str, dict] | None = None) -> DataFrame:
    """The same documents under several strategies, with a ``strategy`` column."""
    out = None
    for strategy, chosen in (options or {"fixed": {}, "sentence": {}, "paragraph": {}, "recursive": {}}).items():
        part = build_chunks(docs, strategy, **chosen)
        out = part if out is None else out.unionByName(part)
    return out


def sections(pages: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``(…, path, section_index, section_text)`` for each section of a text with ``==`` headings.

    A heading closes levels as deep or deeper. The preamble has an empty path, as has a text without headings.
    """
    mark = "\u0001"
    heading = r"(?m)^(={2,6})[ \t]*(.*?)[ \t]*\1[ \t]*$"
    parts = F.split(F.regexp_replace(F.col(text), heading, mark + "$1\u0002$2\u0002"), mark)

    def piece(p: Column, i: Column) -> Column:
        cut = F.split(p, "\u0002", 3)
        head = i > 0
        level = F.when(head, F.length(F.get(cut, F.lit(0)))).otherwise(F.lit(0))
        title = F.when(head, F.trim(F.regexp_replace(F.get(cut, F.lit(1)), r"\{\{[^{}]*\}\}", "")))
        body = F.when(head, F.get(cut, F.lit(2))).otherwise(p)
        return F.struct(level.alias("level"), title.alias("title"), T.strip(body).alias("body"))

    item = "struct<level:int,title:string>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("open"), F.array().cast("array<struct<path:array<string>,body:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.filter(acc.open, lambda o: o.level < x.level)
        opened = F.when(x.level > 0, F.concat(kept, F.array(F.struct(x.level.alias("level"), x.title.alias("title"))))).otherwise(kept)
        row = F.struct(F.transform(opened, lambda o: o.title).alias("path"), x.body.alias("body"))
        return F.struct(opened.alias("open"), F.concat(acc.out, F.array(row)).alias("out"))

    found = F.aggregate(F.transform(parts, piece), start, step, lambda acc: acc.out)
    found = F.filter(found, lambda s: (F.size(s.path) > 0) | (s.body != "") | (F.size(parts) == 1))
    rows = pages.select(*pages.columns, F.posexplode(found).alias("section_index", "s"))
    return rows.select(*pages.columns, F.col("s.path").alias("path"), "section_index", F.col("s.body").alias("section_text"))


def keep_sections(rows: DataFrame, keep: list[str], skip: list[str]) -> DataFrame:
    """Sections whose path starts in ``keep`` and meets none of ``skip``."""
    low = F.transform(F.col("path"), lambda p: F.lower(p))
    wanted, unwanted = (F.array(*[F.lit(x.lower()) for x in names]).cast("array<string>") for names in (keep, skip))
    return rows.filter((F.size("path") > 0) & ~F.arrays_overlap(low, unwanted) & F.array_contains(wanted, F.get(low, F.lit(0))))


def min_words(rows: DataFrame, least: int = 60, text: str = "section_text") -> DataFrame:
    """Rows of at least ``least`` words."""
    return rows.filter(T.token_count(F.col(text)) >= least)


def corpus_chunks(pages: DataFrame, keep: list[str], skip: list[str], least: int = 60) -> DataFrame:
    """Chunks ``(chunk_id, slug, section_path, text, word_count, source_url, source_license)`` of kept sections.

    Ids are slug/section-slug-NNN, from 001 within each section.
    """
    rows = min_words(keep_sections(sections(pages), keep, skip), least)
    plain = T.wiki_to_text(F.col("section_text"))
    rows = rows.select("slug", "url", "license", "path", F.posexplode(band(plain)).alias("i", "chunk"))
    last = T.slugify(F.element_at("path", -1))
    return rows.select(
        F.format_string("%s/%s-%03d", F.col("slug"), last, F.col("i") + 1).alias("chunk_id"), "slug", F.col("path").alias("section_path"), F.col("chunk").alias("text"),
        T.token_count(F.col("chunk")).alias("word_count"), F.col("url").alias("source_url"), F.col("license").alias("source_license"),
    )
