"""Queries that search documents and embeddings, and assemble context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assemble as A
from tessera.operators import chunk, evaluate, rank, vector_index
from tessera.operators import retrieve as E
from tessera.plans.base import query, table


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")


def _toks(c):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> ''))"


_QT = f"(SELECT item_id AS query_id, len(t) AS n_query, unnest(t) AS token FROM (SELECT item_id, {_toks('text')} AS t FROM benchmark))"
_CT = f"(SELECT doc_id AS chunk_id, len(t) AS n_chunk, unnest(t) AS token FROM (SELECT doc_id, {_toks('text')} AS t FROM documents))"
_MET = f"(SELECT query_id, chunk_id, n_query, n_chunk, count(*) AS shared FROM {_QT} JOIN {_CT} USING (token) GROUP BY ALL)"
_KEYWORD = f"(SELECT query_id, chunk_id, shared::DOUBLE / (n_query + 1) AS score FROM {_MET})"
# Searches give rows that share no token too, after the others.
_EVERY = "(SELECT b.item_id AS query_id, d.doc_id AS chunk_id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN {scores} s ON s.query_id = b.item_id AND s.chunk_id = d.doc_id)"
_SEARCHED = _EVERY.format(scores=_KEYWORD)


def _top(rows, k, order="score DESC, chunk_id"):
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {rows}) WHERE rank <= {k})"


_TOP5 = _top(_SEARCHED, 5)


@query(f"SELECT query_id, chunk_id, score, rank FROM {_TOP5}")
def keyword_topk(spark, sf_dir):
    return E.keyword_topk(_queries(spark, sf_dir), _documents(spark, sf_dir), 5)


@query(f"SELECT query_id, chunk_id, score, rank FROM {_top(_EVERY.format(scores=f'(SELECT query_id, chunk_id, shared::DOUBLE / (n_query + n_chunk - shared) AS score FROM {_MET})'), 5)}")
def jaccard_topk(spark, sf_dir):
    return E.jaccard_topk(_queries(spark, sf_dir), _documents(spark, sf_dir), 5)


_FILTERED3 = _top(f'(SELECT k.* FROM {_SEARCHED} k JOIN documents d ON d.doc_id = k.chunk_id WHERE source = (CASE WHEN query_id % 2 = 0 THEN {chr(39)}src1{chr(39)} ELSE {chr(39)}src2{chr(39)} END))', 3)


@query(f"SELECT query_id, chunk_id, score, rank FROM {_FILTERED3}")
def filtered_topk(spark, sf_dir):
    q = _queries(spark, sf_dir).withColumn("source", F.when(F.col("query_id") % 2 == 0, "src1").otherwise("src2"))
    return E.keyword_topk(q, _documents(spark, sf_dir), 3, where=["source"])


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding, v.embedding)::DOUBLE AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return E.vector_topk(q, v, 10).withColumn("score", F.round("score", 4))


@query()
def vector_topk_lsh(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return E.vector_topk_lsh(q, v, 10, bits=4)  # these vectors are nearly orthogonal: wide buckets


@query()
def vector_topk_ivf(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    # These vectors are nearly orthogonal: most lists are scanned by their codes, few vectors are scored.
    return vector_index.search(vector_index.build(v, cells=32), q, 10, probes=24, rerank=15)


def _candidates(spark, sf_dir, k=20):
    top = E.keyword_topk(_queries(spark, sf_dir), _documents(spark, sf_dir), k)
    return top.join(_documents(spark, sf_dir).select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "text", "score", "rank")


def _shorter_first(frame):
    return -frame["text"].str.len() + 0.0


_TOP20 = f"(SELECT t.*, d.text FROM {_top(_SEARCHED, 20)} t JOIN documents d ON d.doc_id = t.chunk_id)"


@query(f"SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text), rank) AS rank FROM {_TOP20} QUALIFY rank <= 5".replace("QUALIFY rank", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(text), rank)"))
def rerank_two_stage(spark, sf_dir):
    return E.with_rerank(_candidates(spark, sf_dir), _shorter_first, 5).select("query_id", "chunk_id", "rank")


@query(f"SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank DESC)) AS rank FROM {_TOP5}")
def rerank_reverse(spark, sf_dir):
    return E.with_rerank(_candidates(spark, sf_dir, 5), None, 5, reverse=True).select("query_id", "chunk_id", "rank")


@query(
    f"""WITH c AS (SELECT * FROM {_TOP5}), m AS (SELECT query_id, chunk_id, rank - 1 AS idx, CASE WHEN query_id % 2 = 0 THEN rank / 10.0 ELSE score END AS s FROM c WHERE query_id % 2 = 1 OR rank % 2 = 1)
    SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, idx) AS rank FROM m) WHERE rank <= 4"""
)
def rerank_apply(spark, sf_dir):
    c = E.keyword_topk(_queries(spark, sf_dir), _documents(spark, sf_dir), 5)
    odd = c.filter("query_id % 2 = 0 and rank % 2 = 1").select("query_id", (F.col("rank") - 1).alias("idx"), (F.col("rank") / 10).alias("relevance"))
    results = odd.select("query_id", F.explode(F.array("idx", "idx", F.col("idx") + 50)).alias("idx"), "relevance")  # repeated and out of range
    return E.apply_rerank(c, results, 4).select("query_id", "chunk_id", "rank")


def _vector_candidates(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = E.vector_topk(q, v, 20)
    top = top.join(v.select("vec_id", "embedding"), "vec_id").join(q.select("query_id", F.col("embedding").alias("query_embedding")), "query_id")
    return top.withColumnRenamed("vec_id", "chunk_id")


@query()
def mmr(spark, sf_dir):
    return rank.mmr(_vector_candidates(spark, sf_dir), 5).select("query_id", "chunk_id", "rank")


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.embedding, v.embedding)::DOUBLE AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
    SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5"""
)
def mmr_without_vectors(spark, sf_dir):
    return rank.mmr(_vector_candidates(spark, sf_dir).drop("rank"), 5, embedding=None).select("query_id", "chunk_id", "rank")


@query(f"SELECT query_id, chunk_id, score FROM {_TOP5} WHERE score >= 0.6")
def min_score(spark, sf_dir):
    return E.min_score(E.keyword_topk(_queries(spark, sf_dir), _documents(spark, sf_dir), 5), 0.6).select("query_id", "chunk_id", "score")


@query()
def dedup_within_query(spark, sf_dir):
    return rank.dedup_jaccard(_candidates(spark, sf_dir), 0.9).select("query_id", "chunk_id", "rank")


@query(
    f"""WITH s AS (SELECT source, min(doc_id) AS id, t FROM (SELECT source, doc_id, list_sort({_toks('text')}) AS t FROM documents) GROUP BY source, t HAVING len(t) > 0),
    p AS (SELECT a.source, a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS n, len(a.t) AS na, len(b.t) AS nb FROM s a JOIN s b ON a.source = b.source AND a.id < b.id AND least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t)) - 1e-9)
    SELECT source, a, b, round(n / (na + nb - n)::DOUBLE, 6) AS score FROM p WHERE n / (na + nb - n)::DOUBLE >= 0.8"""
)
def jaccard_pairs(spark, sf_dir):
    return rank.jaccard_pairs(table(spark, sf_dir, "documents"), "source", "doc_id")[0].withColumn("score", F.round("score", 6))


@query(f"SELECT source, doc_id AS id, min(doc_id) OVER (PARTITION BY source, list_sort({_toks('text')})) AS least FROM documents")
def jaccard_members(spark, sf_dir):
    return rank.set_members(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 7 ELSE 3 END AS k FROM events")
def k_by_mode(spark, sf_dir):
    mode = F.when(F.col("event_type") == "view", "deep_research").when(F.col("event_type") == "click", "debate").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", E.k_for_mode(mode).alias("k"))


_SCOPED = f"(SELECT k.* FROM {_KEYWORD} k JOIN documents d ON d.doc_id = k.chunk_id WHERE query_id % 3 = 0 AND source = 'src1')"


def _scoped(spark, sf_dir):
    q, c = _queries(spark, sf_dir), _documents(spark, sf_dir)
    return E.keyword_scores(q.filter("query_id % 3 = 0"), c.filter("source = 'src1'")), E.keyword_scores(q, c)


@query(
    f"""WITH s AS (SELECT *, 0 AS part FROM {_top(_SCOPED, 5)}), g AS (SELECT *, 1 AS part FROM {_top(_KEYWORD, 'CASE WHEN query_id IN (SELECT query_id FROM s) THEN 2 ELSE 7 END')})
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM (SELECT * FROM s UNION ALL SELECT * FROM g)"""
)
def split_topk(spark, sf_dir):
    return E.split_topk(*_scoped(spark, sf_dir))


@query(f"WITH s AS (SELECT query_id, chunk_id, score FROM {_SCOPED} WHERE score > 0.6) SELECT * FROM s UNION ALL SELECT query_id, chunk_id, score FROM {_top(_KEYWORD, 3)} WHERE query_id NOT IN (SELECT query_id FROM s)")
def scoped_or_general(spark, sf_dir):
    scoped, general = _scoped(spark, sf_dir)
    return E.scoped_or_general(scoped.filter("score > 0.6"), E.topk(general, 3, order=("chunk_id",)).drop("rank"))


_ALIASES = [("mit license", "mit", 0), ("license", "any-license", 1), ("apache license", "apache", 2), ("rights reserved", "reserved", 3), ("gnu general public license", "gpl", 4)]
_ALIAS_SQL = "(VALUES " + ", ".join(f"('{a}', '{s}', {o})" for a, s, o in _ALIASES) + ") a(alias, slug, ordinal)"


@query(f"SELECT d.doc_id, b.slug FROM documents d LEFT JOIN (SELECT doc_id, arg_max(slug, (length(alias), -ordinal)) AS slug FROM documents, {_ALIAS_SQL} WHERE contains(lower(text), alias) AND regexp_matches(lower(text), '(^|\\W)' || alias || '($|\\W)') GROUP BY doc_id) b USING (doc_id)")
def detect_alias(spark, sf_dir):
    aliases = spark.createDataFrame(_ALIASES, "alias string, slug string, ordinal int")
    return E.detect_alias(table(spark, sf_dir, "documents"), "text", aliases, "doc_id").select("doc_id", "slug")


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'fr' ELSE regexp_replace(lower(n_name), '\\s+', '-', 'g') END AS slug FROM nation")
def normalise_alias(spark, sf_dir):
    aliases = spark.createDataFrame([("France", "fr", 0)], "alias string, slug string, ordinal int")
    return E.normalise_alias(table(spark, sf_dir, "nation"), "n_name", aliases).select("n_nationkey", "slug")


@query("SELECT doc_id, trim(source || ' ' || lang, ' ') AS query_text FROM documents")
def query_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.query_text(F.col("source"), F.col("lang")).alias("query_text"))


@query("SELECT count(*) AS queries, count(DISTINCT lower(trim(role || ' ' || (conv_id % 5), ' '))) AS once FROM conversations")
def distinct_queries(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.concat_ws(" ", "role", (F.col("conv_id") % 5).cast("string")).alias("text"), F.lit("c").alias("collection"), F.lit(5).alias("k"))
    once, keys = E.distinct_queries(q)
    return keys.join(once.select("query_key"), "query_key").agg(F.count("*").alias("queries"), F.count_distinct("query_key").alias("once"))


@query(f"SELECT query_id, chunk_id, rank, substr(text, 1, 300) AS text FROM (SELECT t.*, d.text FROM {_top(_SEARCHED, 8)} t JOIN documents d ON d.doc_id = t.chunk_id) WHERE rank <= 5")
def citations(spark, sf_dir):
    return E.citations(_candidates(spark, sf_dir, 8)).select("query_id", "chunk_id", "rank", "text")


@query(f"SELECT item_id AS query_id, coalesce(context, 'No context retrieved.') AS context FROM benchmark LEFT JOIN (SELECT query_id, string_agg('[' || chunk_id || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM {_TOP20} WHERE rank <= 3 AND score > 0.5 GROUP BY query_id) ON query_id = item_id")
def context_string(spark, sf_dir):
    rows = _candidates(spark, sf_dir, 3).filter("score > 0.5").withColumnRenamed("chunk_id", "doc_id")
    return E.context_string(_queries(spark, sf_dir), rows)


def _items(spark, sf_dir):
    rows = _candidates(spark, sf_dir, 4).join(_documents(spark, sf_dir).select("chunk_id", F.col("source").alias("chapter")), "chunk_id")
    return rows.withColumnRenamed("chunk_id", "doc_id")


_ITEMS = f"(SELECT t.query_id, t.rank, t.chunk_id AS doc_id, d.source AS chapter, d.text, t.score FROM {_top(_SEARCHED, 4)} t JOIN documents d ON d.doc_id = t.chunk_id)"
_CUT = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_HEAD = "'Relevant knowledge:' || chr(10) || chr(10) || "
_NL = "chr(10) || chr(10)"


def _formatted(body, name):
    def run(spark, sf_dir):
        fields = F.struct("rank", "doc_id", "chapter", "text", "score")
        return _items(spark, sf_dir).groupBy("query_id").agg(A.FORMATS[name](F.sort_array(F.collect_list(fields))).alias("context"))

    run.__name__ = f"format_{name}"
    return query(f"SELECT query_id, {_CUT.format(x=_HEAD + body)} AS context FROM {_ITEMS} GROUP BY query_id")(run)


format_naive = _formatted(f"string_agg(text, {_NL} ORDER BY rank)", "naive")
format_relevance = _formatted(f"string_agg('[' || rank || '] (score=' || printf('%.2f', round(score::DECIMAL(18, 6), 2)::DOUBLE) || ') ' || text, {_NL} ORDER BY rank)", "relevance")
format_sandwich = _formatted(
    f"'[Key passage] ' || min(text) FILTER (rank = 1) || coalesce({_NL} || string_agg(text, {_NL} ORDER BY rank) FILTER (rank > 1), '') || {_NL} || '[Key passage – repeated for emphasis] ' || min(text) FILTER (rank = 1)", "sandwich"
)
format_citation = _formatted(f"string_agg('[' || rank || '] ' || text, {_NL} ORDER BY rank) || {_NL} || 'Sources: ' || string_agg('[' || rank || '] ' || doc_id || ', ' || chapter, ' | ' ORDER BY rank)", "citation")


@query()
def assemble_context(spark, sf_dir):
    return A.assemble(_items(spark, sf_dir), "sandwich", 0.5, 3, 0.95, queries=_queries(spark, sf_dir))


@query(f"SELECT query_id, 'retrieval' AS role, context AS content FROM ({{}})".format(f"SELECT query_id, string_agg(text, '|' ORDER BY rank) AS context FROM {_ITEMS} WHERE score > 0.5 GROUP BY query_id"))
def as_messages(spark, sf_dir):
    rows = _items(spark, sf_dir).filter("score > 0.5").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s.text), "|").alias("context"))
    every = _queries(spark, sf_dir).select("query_id").join(rows, "query_id", "left").fillna("", ["context"])
    return A.as_messages(every).select("query_id", "message.role", "message.content")


_EXPECTED = "(SELECT b.item_id AS id, list(d.doc_id ORDER BY d.doc_id) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"


def _questions(spark, sf_dir):
    """Benchmark items with the documents that hold them."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    held = evaluate.holders(table(spark, sf_dir, "documents"), b).groupBy("id").agg(F.collect_set("doc_id").alias("expected_docs"))
    rows = b.join(held, "id", "left").withColumn("expected_docs", F.coalesce("expected_docs", F.array().cast("array<bigint>")))
    n = F.size("expected_docs")
    return rows.select("id", "question", "expected_docs", F.when(n == 0, "distractor").when(n == 1, "easy").otherwise("multi").alias("kind"))


def _chunk_rank(spark, sf_dir, strategy, **options):
    """Documents in the order of their best chunk."""
    chunks = chunk.build_chunks(table(spark, sf_dir, "documents"), strategy, **options)
    return E.keyword_topk(_queries(spark, sf_dir), chunks, 10, chunk_id="doc_id")


_HITS_OF = """(SELECT b.item_id AS id, CASE WHEN docs IS NULL THEN 'distractor' WHEN len(docs) = 1 THEN 'easy' ELSE 'multi' END AS kind, coalesce(docs, []) AS docs, list(t.chunk_id ORDER BY rank) AS got
 FROM benchmark b LEFT JOIN {expected} e ON e.id = b.item_id LEFT JOIN {top} t ON t.query_id = b.item_id GROUP BY ALL)"""
_SCORED_OF = "(SELECT id, kind, kind = 'distractor' OR len(list_intersect(docs, got)) > 0 AS hit, CASE WHEN kind = 'distractor' OR len(docs) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(docs, got))::DOUBLE / len(docs) END AS recall FROM " + _HITS_OF + ")"
_SCORED = _SCORED_OF.format(expected=_EXPECTED, top=_TOP5)


def _scored(spark, sf_dir):
    got = E.keyword_topk(_queries(spark, sf_dir), _documents(spark, sf_dir), 5).select(F.col("query_id").alias("id"), F.col("chunk_id").alias("doc_id"))
    return evaluate.hit_recall(got, _questions(spark, sf_dir))


@query(f"SELECT id, kind, hit, recall FROM {_SCORED}")
def hit_recall(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "kind", "hit", "recall")


@query(f"SELECT kind AS strategy, round(avg(hit::INT) FILTER (kind <> 'distractor'), 6) AS hit_rate, round(avg(recall) FILTER (kind <> 'distractor'), 6) AS recall, count(*) AS n FROM {_SCORED} GROUP BY kind")
def summarise_strategy(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumns({"strategy": F.col("kind"), "tokens": F.lit(1)})
    return evaluate.summarise_strategy(rows).drop("tokens").withColumns({c: F.round(c, 6) for c in ("hit_rate", "recall")})


@query("SELECT id, kind FROM {} WHERE NOT hit".format(_SCORED_OF.format(expected=_EXPECTED, top=_FILTERED3)))
def misses(spark, sf_dir):
    """A search of one source misses what other sources hold."""
    got = filtered_topk(spark, sf_dir).select(F.col("query_id").alias("id"), F.col("chunk_id").alias("doc_id"))
    return evaluate.misses(evaluate.hit_recall(got, _questions(spark, sf_dir))).select("id", "kind")


_RANKS = f"(SELECT item_id AS query_id, min(rank) AS rank FROM benchmark LEFT JOIN (SELECT t.query_id, t.rank FROM {_top(_SEARCHED, 10)} t JOIN documents d ON d.doc_id = t.chunk_id WHERE contains(lower(d.source), CASE WHEN t.query_id % 2 = 0 THEN 'src1' ELSE 'src2' END)) ON query_id = item_id GROUP BY item_id)"


def _ranks(spark, sf_dir):
    top = E.keyword_topk(_queries(spark, sf_dir), _documents(spark, sf_dir), 10).join(_documents(spark, sf_dir).select("chunk_id", F.col("source").alias("name")), "chunk_id")
    patterns = _queries(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 2 == 0, "SRC1").otherwise("src2").alias("pattern"))
    return evaluate.first_match_rank(top, patterns)


@query(f"SELECT query_id, rank, coalesce(rank <= 5, false) AS hit5, coalesce(rank <= 10, false) AS hit10, coalesce(1.0::DOUBLE / rank, 0) AS reciprocal FROM {_RANKS}")
def first_match_rank(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(f"SELECT round(avg(coalesce(rank <= 5, false)::INT), 6) AS recall_at_5, round(avg(coalesce(rank <= 10, false)::INT), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr_at_10, count(*) AS n FROM {_RANKS}")
def pattern_metrics(spark, sf_dir):
    return evaluate.retrieval_metrics(_ranks(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("recall_at_5", "recall_at_10", "mrr_at_10")})


_NOW = f"(SELECT query_id, min(rank) AS rank FROM (SELECT t.query_id, t.rank, t.chunk_id FROM {_top(_SEARCHED, 10)} t) JOIN (SELECT id, unnest(docs) AS doc_id FROM {_EXPECTED}) x ON x.id = query_id AND x.doc_id = chunk_id GROUP BY query_id)"
_WAS = _NOW.replace("shared::DOUBLE / (n_query + 1)", "shared::DOUBLE / (n_query + n_chunk - shared)")


def _expected_ranks(spark, sf_dir, top):
    q = _questions(spark, sf_dir)
    wanted = q.select(F.col("id").alias("query_id"), F.explode("expected_docs").alias("chunk_id"))
    found = top.join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return _queries(spark, sf_dir).select("query_id").join(found, "query_id", "left")


@query(
    f"""SELECT item_id AS query_id, w.rank AS was, n.rank AS now, CASE WHEN w.rank IS NULL AND n.rank IS NULL THEN 'unchanged miss' WHEN w.rank IS NULL THEN 'improved' WHEN n.rank IS NULL THEN 'regressed'
    WHEN abs(w.rank - n.rank) <= 1 AND w.rank <= 5 AND n.rank <= 5 THEN 'held' WHEN n.rank < w.rank THEN 'improved' WHEN n.rank > w.rank THEN 'regressed' ELSE 'held' END AS verdict
    FROM benchmark LEFT JOIN {_WAS} w ON w.query_id = item_id LEFT JOIN {_NOW} n ON n.query_id = item_id"""
)
def rank_delta(spark, sf_dir):
    q, c = _queries(spark, sf_dir), _documents(spark, sf_dir)
    return evaluate.rank_delta(_expected_ranks(spark, sf_dir, E.jaccard_topk(q, c, 10)), _expected_ranks(spark, sf_dir, E.keyword_topk(q, c, 10)))


_CHUNKED = """(SELECT doc_id, i AS chunk_index, array_to_string(w[i+1:i+300], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 250)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents)))"""
_BEST = f"""(SELECT query_id, doc_id, max(score) AS score FROM (SELECT query_id, doc_id, chunk_index, count(*)::DOUBLE / (n_query + 1) AS score FROM {_QT} JOIN
 (SELECT doc_id, chunk_index, unnest({_toks('text')}) AS token FROM {_CHUNKED}) USING (token) GROUP BY query_id, doc_id, chunk_index, n_query) GROUP BY query_id, doc_id)"""
_FOUND = f"(SELECT query_id, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {_BEST}) t JOIN (SELECT id, unnest(docs) AS doc FROM {_EXPECTED}) x ON x.id = query_id AND x.doc = doc_id WHERE rank <= 10 GROUP BY query_id)"


@query(f"SELECT round(avg(coalesce(f.rank <= 5, false)::INT), 6) AS recall_at_5, round(avg(coalesce(f.rank <= 10, false)::INT), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / f.rank, 0)), 6) AS mrr_at_10, count(*) AS n FROM {_EXPECTED} e LEFT JOIN {_FOUND} f ON f.query_id = e.id")
def retrieval_metrics(spark, sf_dir):
    """Documents -> fixed chunks -> keyword top-k -> expected documents -> hit@k and MRR."""
    wanted = _questions(spark, sf_dir).filter("kind <> 'distractor'").select(F.col("id").alias("query_id"), F.explode("expected_docs").alias("doc_id"))
    top = _chunk_rank(spark, sf_dir, "fixed")
    ranks = wanted.join(top, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    ranks = ranks.select("query_id", F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("hit5"), F.coalesce(F.col("rank") <= 10, F.lit(False)).alias("hit10"), F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal"))
    return evaluate.retrieval_metrics(ranks).withColumns({c: F.round(c, 6) for c in ("recall_at_5", "recall_at_10", "mrr_at_10")})
