"""Queries over documents and pages: cleaning, chunking, incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk, hooks, registry
from tessera.plans.base import count_sql, fixed_sql, query, table, words_sql
from tessera.session import shared_path
from tessera.sources.store import KeyedStore

def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with wiki-like markup around their text."""
    docs = table(spark, sf_dir, "documents")
    parts = [F.lit("{{Infobox|a=1}}Front '''"), F.col("source"), F.lit("''' is here<ref name=\"x\">cite "), F.col("doc_id").cast("string"), F.lit("</ref> and <ref name=y /> there.<!-- gone\nnow -->\n| row = "), F.col("lang"), F.lit("\n120px|thumb|caption\nCategory:"), F.col("lang"), F.lit("\n\n\n\n"), F.col("text"), F.lit("\n== Biography ==\n"), F.col("text"), F.lit("\n=== Early life {{x}} ===\n"), F.col("text"), F.lit("\n== References ==\nnone")]
    return docs.select("doc_id", "lang", "source", F.concat(*parts).alias("markup"))


MARKED_SQL = """(SELECT doc_id, lang, source, '{{Infobox|a=1}}Front ''''''' || source || ''''''' is here<ref name="x">cite ' || doc_id || '</ref> and <ref name=y /> there.<!-- gone' || chr(10) || 'now -->' || chr(10) || '| row = ' || lang
 || chr(10) || '120px|thumb|caption' || chr(10) || 'Category:' || lang || chr(10) || chr(10) || chr(10) || chr(10) || text || chr(10) || '== Biography ==' || chr(10) || text
 || chr(10) || '=== Early life {{x}} ===' || chr(10) || text || chr(10) || '== References ==' || chr(10) || 'none' AS markup FROM documents)"""

_REFS = r"regexp_replace(regexp_replace(regexp_replace(markup, '(?is)<ref[^>/]*/>', '', 'g'), '(?is)<ref[^>]*>.*?</ref>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_CLERICAL = r"array_to_string(list_filter(string_split(markup, chr(10)), lambda x: NOT (starts_with(regexp_replace(x, '^\s+', ''), '|') OR starts_with(regexp_replace(x, '^\s+', ''), '{{') OR starts_with(regexp_replace(x, '^\s+', ''), '}}') OR starts_with(regexp_replace(x, '^\s+', ''), 'Category:'))), chr(10))"


@query(f"SELECT doc_id, {_REFS} AS cleaned FROM {MARKED_SQL}")
def strip_refs(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.strip_refs(F.col("markup")).alias("cleaned"))


@query(f"SELECT doc_id, {_CLERICAL} AS cleaned FROM {MARKED_SQL}")
def drop_clerical(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.drop_clerical(F.col("markup")).alias("cleaned"))


@query(rf"SELECT doc_id, regexp_replace(markup, '(?m)^\s*(?:\d+px\||thumb\||left\||right\||center\||border\|)+[^\n]*$', '', 'g') AS cleaned FROM {MARKED_SQL}")
def drop_image_residue(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.drop_image_residue(F.col("markup")).alias("cleaned"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<nav\b.*?</nav\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS page_text FROM a"""
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("page_text"))


@query()
def wiki_to_text(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.wiki_to_text(F.col("markup")).alias("plain"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(markup, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM {MARKED_SQL}")
def normalise_whitespace(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.normalise_ws(F.col("markup")).alias("cleaned"))


@query(rf"SELECT doc_id, regexp_replace(split_part(substr(markup, instr(markup, '''''''')), chr(10) || '==', 1), '^\s+|\s+$', '', 'g') AS lead_text FROM {MARKED_SQL}")
def lead_text(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.lead(F.col("markup")).alias("lead_text"))


@query(
    rf"""WITH a AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split('Warning: x' || chr(10) || text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
      lambda x: NOT (x = '' OR starts_with(lower(x), 'this article is about') OR starts_with(lower(x), 'you may be looking for') OR starts_with(lower(x), 'warning:') OR starts_with(lower(x), 'spoiler:'))), ' ') AS j FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(j, '\s+', ' ', 'g'), '\s+,', ',', 'g'), ',\s*,+', ',', 'g'), '\(\s*,?\s*\)', '', 'g'), '\s+\.', '.', 'g'), '\s{{2,}}', ' ', 'g') AS j FROM a),
    c AS (SELECT doc_id, j, {words_sql("j")} AS w FROM b)
    SELECT doc_id, CASE WHEN len(w) <= 60 THEN j ELSE regexp_replace(array_to_string(w[1:60], ' '), '[,.;:]+$', '') || '…' END AS paragraph FROM c"""
)
def collapse_paragraph(spark, sf_dir):
    text = F.concat(F.lit("Warning: x\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_paragraph(text, 60).alias("paragraph"))


@query("SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM documents)")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query()
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))


def _sections(spark, sf_dir):
    return chunk.sections(marked(spark, sf_dir).select("doc_id", F.col("markup").alias("text"))).drop("text")


@query()
def section_tree(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(
    rf"""SELECT doc_id, ['Biography'] AS path, regexp_replace(text, '^\s+|\s+$', '', 'g') AS section_text FROM documents
    WHERE {count_sql("text")} >= 60
    UNION ALL SELECT doc_id, ['Biography', 'Early life'], regexp_replace(text, '^\s+|\s+$', '', 'g') FROM documents WHERE {count_sql("text")} >= 60"""
)
def kept_sections(spark, sf_dir):
    rows = chunk.keep_sections(_sections(spark, sf_dir), ["biography", "relationships"], ["references", "trivia"])
    return chunk.min_words(rows, 60).select("doc_id", "path", "section_text")


@query()
def corpus_chunks(spark, sf_dir):
    pages = marked(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"), F.col("source").alias("url"), F.col("lang").alias("license"), F.col("markup").alias("text"))
    return chunk.corpus_chunks(pages, ["biography", "relationships"], ["references", "trivia"])


_CHUNKS = "SELECT doc_id, (i - 1)::INT AS chunk_index, c[i] AS text, '{name}' AS strategy FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {sql} AS c FROM documents))"
_PARAGRAPHS = r"list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
_SENTENCE_PARTS = r"string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_SENTENCE = f"[array_to_string(({_SENTENCE_PARTS})[i+1:i+5], ' ') for i in range(0, len({_SENTENCE_PARTS}), 5)]"
_FIXED_SQL = _CHUNKS.format(name="fixed", sql=fixed_sql("text"))
_SENTENCE_SQL = _CHUNKS.format(name="sentence", sql=_SENTENCE)
_PARAGRAPH_SQL = _CHUNKS.format(name="paragraph", sql=_PARAGRAPHS)


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "chunk_index", "text", "strategy")


@query(_FIXED_SQL)
def chunk_fixed(spark, sf_dir):
    return _slim(chunk.build_chunks(table(spark, sf_dir, "documents"), "fixed"))


@query(_SENTENCE_SQL)
def chunk_sentence(spark, sf_dir):
    return _slim(chunk.build_chunks(table(spark, sf_dir, "documents"), "sentence"))


@query(_PARAGRAPH_SQL)
def chunk_paragraph(spark, sf_dir):
    return _slim(chunk.build_chunks(table(spark, sf_dir, "documents"), "paragraph", sep="\n"))


_RECURSIVE_SQL = rf"""WITH p AS (SELECT doc_id, c[i] AS p, i FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {_PARAGRAPHS} AS c FROM documents))),
    w AS (SELECT doc_id, i, p, {words_sql("p")} AS w FROM p),
    x AS (SELECT doc_id, i, 0 AS k, p AS text FROM w WHERE len(w) <= 300
      UNION ALL SELECT doc_id, i, k, array_to_string(w[k+1:k+300], ' ') FROM (SELECT *, unnest(range(0, len(w), 250)) AS k FROM w WHERE len(w) > 300))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS chunk_index, text, 'recursive' AS strategy FROM x"""


@query(_RECURSIVE_SQL)
def chunk_recursive(spark, sf_dir):
    return _slim(chunk.build_chunks(table(spark, sf_dir, "documents"), "recursive", sep="\n"))


@query()
def chunk_band(spark, sf_dir):
    return _slim(chunk.build_chunks(table(spark, sf_dir, "documents"), "band"))


@query(f"SELECT sha256(doc_id || '|' || chunk_index || '|' || strategy) AS chunk_id, doc_id, chunk_index, strategy, 'text' AS chunk_type, text FROM ({_FIXED_SQL})")
def chunk_rows(spark, sf_dir):
    return chunk.build_chunks(table(spark, sf_dir, "documents"), "fixed")


@query(f"SELECT sha256(doc_id || '|' || chunk_index || '|' || strategy) AS chunk_id, doc_id, 'lore' AS collection, 'text' AS chunk_type FROM ({_FIXED_SQL})")
def ingest_with_metadata(spark, sf_dir):
    rows = chunk.with_chunk_type(chunk.ingest(table(spark, sf_dir, "documents"), {"collection": "lore"}))
    return rows.select("chunk_id", "doc_id", F.col("metadata")["collection"].alias("collection"), "chunk_type")


@query(f"SELECT strategy, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, sum({count_sql('text')})::BIGINT AS n_words FROM (SELECT * FROM ({_FIXED_SQL}) UNION ALL SELECT * FROM ({_SENTENCE_SQL}) UNION ALL SELECT * FROM ({_PARAGRAPH_SQL}) UNION ALL SELECT * FROM ({_RECURSIVE_SQL})) GROUP BY strategy")
def chunk_sweep(spark, sf_dir):
    rows = chunk.sweep(table(spark, sf_dir, "documents"), {"fixed": {}, "sentence": {}, "paragraph": {"sep": "\n"}, "recursive": {"sep": "\n"}})
    return rows.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.sum(T.token_count(F.col("text"))).alias("n_words"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def _old(spark, sf_dir):
    """The registry of an earlier run: it lacks every fifth document, and knew every seventh by another text."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 0")
    return docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))


_PLAN = "SELECT doc_id, sha256(text) AS content_hash, CASE WHEN doc_id % 5 = 0 THEN 'created' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'skipped' END AS action FROM documents"


def _plan(spark, sf_dir):
    old = _old(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return registry.plan_upsert(old, table(spark, sf_dir, "documents"))


@query(_PLAN)
def registry_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"SELECT sha256(doc_id || '|' || chunk_index || '|' || strategy) AS chunk_id, doc_id, text FROM ({_FIXED_SQL})")
def registry_apply(spark, sf_dir):
    store = chunk.build_chunks(_old(spark, sf_dir), "fixed")
    fresh = chunk.build_chunks(table(spark, sf_dir, "documents"), "fixed")
    return registry.apply_upsert(store, _plan(spark, sf_dir), fresh).select("chunk_id", "doc_id", "text")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def registry_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return registry.delete_docs(docs, table(spark, sf_dir, "labels").filter("toxic = 1"))


def _registry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return registry.registry(chunk.build_chunks(docs, "fixed"), docs, "mini")


_REGISTRY = f"(SELECT doc_id, list(sha256(doc_id || '|' || chunk_index || '|' || strategy) ORDER BY chunk_index) AS chunk_ids FROM ({_FIXED_SQL}) GROUP BY doc_id)"


@query(f"SELECT d.doc_id, sha256(d.text) AS content_hash, coalesce(array_to_string(chunk_ids, ','), '') AS chunk_ids, coalesce(len(chunk_ids), 0)::INT AS chunk_count, 'mini' AS embedding_model FROM documents d LEFT JOIN {_REGISTRY} USING (doc_id)")
def registry_rows(spark, sf_dir):
    return _registry(spark, sf_dir).select("doc_id", "content_hash", F.array_join("chunk_ids", ",").alias("chunk_ids"), "chunk_count", "embedding_model")


@query(f"SELECT count(*) AS doc_count, (SELECT count(*) FROM ({_FIXED_SQL})) AS chunk_count FROM documents")
def registry_stats(spark, sf_dir):
    return registry.registry_stats(_registry(spark, sf_dir))


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'created' ELSE 'updated' END AS action FROM documents")
def registry_force_reingest(spark, sf_dir):
    old = _old(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return registry.plan_upsert(registry.force_reingest(old), table(spark, sf_dir, "documents")).select("doc_id", "action")


@query("SELECT 'embedding_dim' AS field, '384' AS expected, len(embedding)::VARCHAR AS found, count(*) AS n FROM embeddings GROUP BY len(embedding) UNION ALL SELECT 'embedding_model', 'mini', 'other', count(*) FROM embeddings WHERE label = 3 HAVING count(*) > 0")
def index_check(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumns({"schema_version": F.lit(1), "embedding_model": F.when(F.col("label") == 3, "other").otherwise("mini"), "collection": F.lit("lore")})
    return registry.check_index(rows, 1, "mini", 384, "lore")


@query(f"SELECT count(DISTINCT doc_id) AS doc_count, count(*) AS chunk_count FROM ({_FIXED_SQL})")
def manifest_stats(spark, sf_dir):
    return registry.manifest_stats(chunk.build_chunks(table(spark, sf_dir, "documents"), "fixed"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(spark, sf_dir):
    return registry.todo(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    store = registry.latest(rows.filter("o_orderdate < '1996-01-01'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    new = rows.filter("o_orderdate >= '1996-01-01'")
    return registry.upsert(store, new, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey HAVING o_custkey % 7 <> 0")
def upsert_in_place(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    kept = KeyedStore(spark, shared_path(spark, "store"), rows.schema.simpleString()[len("struct<") : -1], ["o_custkey"], parts=16)
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    kept.upsert(rows.filter("o_orderdate < '1996-01-01'"), newest)
    kept.apply(rows.filter("o_orderdate >= '1996-01-01'"), newest)
    kept.delete(rows.filter("o_custkey % 7 = 0"))
    return kept.read().drop("o_orderdate")


@query("SELECT doc_id, 'd' || doc_id AS title, source || '/' || lang AS url, 'd' || doc_id || ' | ' || source || '/' || lang AS line FROM documents")
def attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.concat_ws("/", "source", "lang").alias("url"))
    return registry.attribution(rows)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def counts_by_key(spark, sf_dir):
    return registry.counts_by(table(spark, sf_dir, "documents"), "lang", "source")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM documents")
def embedded_documents(spark, sf_dir):
    vectors = table(spark, sf_dir, "documents").select("doc_id", hooks.embedder(hooks.hashing_embedder(64))(F.col("text")).alias("v"))
    return vectors.select("doc_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 3).alias("length"))
