"""Queries over the conversations table as a turn log, and over its rows as context entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assemble as A
from tessera.operators import conversation as G
from tessera.operators import hooks
from tessera.plans.base import count_sql, query, table, words_sql


def turns(spark, sf_dir):
    """Turns: a user row and the reply after it. Mode, tokens and cost are made from ids and words."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("reply", F.lead("text").over(w)).filter("role = 'user'").withColumn("turn_index", F.row_number().over(w).cast("long"))
    modes = F.array(*[F.lit(m) for m in ("open_analysis", "guided_learning", "perspective_shift", "none")])
    mode = F.get(modes, ((F.col("conv_id") + F.col("turn_index") * F.col("turn_index")) % 4).cast("int"))
    words = lambda x: F.coalesce(F.regexp_count(x, F.lit(r"\S+")), F.lit(0)).cast("long")
    rows = rows.withColumn("mode", mode).withColumn("user_message", F.regexp_replace("text", "[\"\\\\\n]", " ")).withColumn("said", F.regexp_replace(F.coalesce("reply", F.lit("none")), "[\"\\\\\n]", " "))
    field = F.when(F.col("mode") == "open_analysis", "analysis").when(F.col("mode") == "guided_learning", "explanation").otherwise("character_response")
    return rows.select(
        F.col("conv_id").alias("conversation_id"), "turn_index", "user_message", F.concat(F.lit('{"'), field, F.lit('": "'), F.col("said"), F.lit('"}')).alias("agent_response"), "mode",
        F.when(F.col("conv_id") % 3 == 0, "iris").alias("character"), words(F.col("text")).alias("tokens_in"), words(F.col("reply")).alias("tokens_out"), (words(F.col("text")) / 1000).alias("cost_usd"), "said",
    )


_BASE = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) WHERE role = 'user')"
_CLEAN = "regexp_replace({x}, '[\"\\\\\\n]', ' ', 'g')"
TURNS = f"""(SELECT conv_id AS conversation_id, turn_index, {_CLEAN.format(x='text')} AS user_message, trim({_CLEAN.format(x="coalesce(reply, 'none')")}, ' ') AS said, ['open_analysis', 'guided_learning', 'perspective_shift', 'none'][(conv_id + turn_index * turn_index) % 4 + 1] AS mode,
 CASE WHEN conv_id % 3 = 0 THEN 'iris' END AS character, {count_sql('text')} AS tokens_in, coalesce({count_sql('reply')}, 0) AS tokens_out, {count_sql('text')} / 1000.0::DOUBLE AS cost_usd FROM {_BASE})"""


def summaries(spark, sf_dir):
    """Older summaries of every second conversation."""
    t = turns(spark, sf_dir).filter("conversation_id % 2 = 0 and turn_index <= 2")
    return t.select("conversation_id", F.col("turn_index").alias("up_to_turn"), F.concat(F.lit("so far "), F.col("user_message")).alias("summary"))


_SUMMARIES = f"(SELECT conversation_id, turn_index AS up_to_turn, 'so far ' || user_message AS summary FROM {TURNS} WHERE conversation_id % 2 = 0 AND turn_index <= 2)"
_NEWEST = f"(SELECT conversation_id, max(up_to_turn) AS up_to_turn, arg_max(summary, up_to_turn) AS summary FROM {_SUMMARIES} GROUP BY conversation_id)"


@query(f"SELECT conversation_id, turn_index, user_message FROM {TURNS} WHERE turn_index > 1")
def assign_turns(spark, sf_dir):
    t = turns(spark, sf_dir)
    new = t.filter("turn_index > 1").withColumn("at", F.col("turn_index")).drop("turn_index")
    return G.assign_turns(t.filter("turn_index = 1"), new, ["at"]).select("conversation_id", "turn_index", "user_message")


_RECENT = f"(SELECT t.*, row_number() OVER (PARTITION BY t.conversation_id ORDER BY turn_index DESC) AS r FROM {TURNS} t LEFT JOIN {_NEWEST} n USING (conversation_id) WHERE turn_index > coalesce(up_to_turn, 0))"


@query(f"SELECT conversation_id, n.summary, r.turns FROM {_NEWEST} n FULL JOIN (SELECT conversation_id, string_agg(turn_index || ':' || user_message, '|' ORDER BY turn_index) AS turns FROM {_RECENT} WHERE r <= 2 GROUP BY conversation_id) r USING (conversation_id)")
def load_history(spark, sf_dir):
    h = G.load_history(turns(spark, sf_dir), summaries(spark, sf_dir), 2)
    return h.select("conversation_id", "summary", F.array_join(F.transform("turns", lambda t: F.concat(t.turn_index.cast("string"), F.lit(":"), t.user_message)), "|").alias("turns"))


@query(
    f"""SELECT conversation_id, coalesce(string_agg(line, chr(10) ORDER BY k), '') AS history FROM (
      SELECT conversation_id, 0 AS k, 'Earlier in conversation: ' || summary AS line FROM {_NEWEST}
      UNION ALL SELECT conversation_id, turn_index, '[' || turn_index || '] User: ' || user_message || CASE WHEN said <> '' THEN chr(10) || '     Tutor: ' || said ELSE '' END FROM {_RECENT} WHERE r <= 2) GROUP BY conversation_id"""
)
def format_history(spark, sf_dir):
    return G.format_history(G.load_history(turns(spark, sf_dir), summaries(spark, sf_dir), 2))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def recent_messages(spark, sf_dir):
    return G.recent_messages(table(spark, sf_dir, "conversations"), 3, "conv_id", "turn").select("conv_id", "turn", "role")


@query(f"SELECT conversation_id, turn_index, said FROM {TURNS}")
def durable_field(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("conversation_id", "turn_index", F.when(F.trim("said") == "", F.lit("")).otherwise(G.durable_field(t.agent_response, t["mode"])).alias("said"))


_PLAN = f"(SELECT conversation_id, coalesce(n.up_to_turn, 0) + 1 AS from_turn, c.last - 1 AS up_to_turn FROM (SELECT conversation_id, count(*) AS n, max(turn_index) AS last FROM {TURNS} GROUP BY conversation_id HAVING count(*) > 2) c LEFT JOIN {_NEWEST} n USING (conversation_id) WHERE c.last - 1 >= coalesce(n.up_to_turn, 0) + 1)"


def _plan(spark, sf_dir):
    return G.compaction_plan(turns(spark, sf_dir), summaries(spark, sf_dir), 2, 1)


@query(f"SELECT conversation_id, from_turn, up_to_turn FROM {_PLAN}")
def compaction_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


_FOLDED = f"(SELECT t.* FROM {TURNS} t JOIN {_PLAN} p ON t.conversation_id = p.conversation_id AND turn_index BETWEEN from_turn AND p.up_to_turn)"


@query(f"SELECT conversation_id, arg_max(mode, (n, -first)) AS mode FROM (SELECT conversation_id, mode, count(*) AS n, min(turn_index) AS first FROM {_FOLDED} GROUP BY ALL) GROUP BY conversation_id")
def dominant_mode(spark, sf_dir):
    return G.dominant_mode(G.folded(turns(spark, sf_dir), _plan(spark, sf_dir)))


@query(f"SELECT conversation_id, string_agg('User: ' || user_message || chr(10) || 'Tutor: ' || said, chr(10) ORDER BY turn_index) AS dialogue FROM {_FOLDED} GROUP BY conversation_id")
def summary_dialogue(spark, sf_dir):
    return G.dialogue(G.folded(turns(spark, sf_dir), _plan(spark, sf_dir)))


@query(f"SELECT conv_id, turn, text AS summary FROM conversations WHERE {count_sql('text')} BETWEEN 20 AND 300")
def accept_summary(spark, sf_dir):
    return G.accept_summary(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("summary")))


@query(f"SELECT i.conversation_id, coalesce(c.turns, 0) AS turns, coalesce(c.tokens_in, 0)::BIGINT AS tokens_in, coalesce(c.tokens_out, 0)::BIGINT AS tokens_out, round(coalesce(c.cost_usd, 0), 6) AS cost_usd FROM (SELECT unnest(range(0, 120)) AS conversation_id) i LEFT JOIN (SELECT conversation_id, count(*) AS turns, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, sum(cost_usd) AS cost_usd FROM {TURNS} GROUP BY conversation_id) c USING (conversation_id)")
def conversation_cost(spark, sf_dir):
    ids = spark.range(120).withColumnRenamed("id", "conversation_id")
    return G.conversation_cost(ids, turns(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


@query(f"SELECT conversation_id, turn_index, round(cost_usd, 6) AS cost_usd, round(sum(cost_usd) OVER (PARTITION BY conversation_id ORDER BY turn_index), 6) AS cumulative_usd FROM {TURNS}")
def turn_costs(spark, sf_dir):
    return G.turn_costs(turns(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("cost_usd", "cumulative_usd")})


@query(f"SELECT conversation_id, turn_index, lag(mode) OVER w AS prior_mode, lag(character) OVER w AS prior_character FROM {TURNS} WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_index)")
def prior_turn(spark, sf_dir):
    return G.prior_turn(turns(spark, sf_dir)).select("conversation_id", "turn_index", "prior_mode", "prior_character")


_CONF = "['high', 'low', 'medium'][(conversation_id + turn_index) % 3 + 1]"
_DECIDE = """CASE WHEN {p} IS NULL OR {p} = 'none' THEN [{r}, 'router'] WHEN {r} IS NOT DISTINCT FROM {p} THEN [{p}, 'router']
 WHEN {p} = 'perspective_shift' AND coalesce({c}, '') NOT IN ('', 'Dumbledore') AND {r} IS NOT NULL AND {r} <> 'none' THEN [{p}, 'character-lock'] WHEN {f} = 'high' AND {r} IS NOT NULL AND {r} <> 'none' THEN [{r}, 'router-override'] ELSE [{p}, 'sticky'] END"""


def _conf():
    return F.get(F.array(F.lit("high"), F.lit("low"), F.lit("medium")), ((F.col("conversation_id") + F.col("turn_index")) % 3).cast("int"))


@query(f"SELECT conversation_id, turn_index, d[1] AS mode, d[2] AS source FROM (SELECT conversation_id, turn_index, {_DECIDE.format(p='pm', r='mode', c='pc', f=_CONF)} AS d FROM (SELECT *, lag(mode) OVER w AS pm, lag(character) OVER w AS pc FROM {TURNS} WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_index)))")
def decide_mode(spark, sf_dir):
    t = G.prior_turn(turns(spark, sf_dir))
    return t.select("conversation_id", "turn_index", G.decide_mode(t["mode"], _conf(), t.prior_mode, t.prior_character).alias("d")).select("conversation_id", "turn_index", "d.mode", "d.source")


@query(
    f"""WITH RECURSIVE t AS (SELECT conversation_id, turn_index, mode AS routed, character, {_CONF} AS conf FROM {TURNS}),
    e AS (SELECT conversation_id, turn_index, routed AS mode, 'router' AS source, character FROM t WHERE turn_index = 1
      UNION ALL SELECT conversation_id, turn_index, d[1], d[2], character FROM (SELECT t.conversation_id, t.turn_index, t.character, {_DECIDE.format(p='e.mode', r='t.routed', c='e.character', f='t.conf')} AS d FROM t JOIN e ON t.conversation_id = e.conversation_id AND t.turn_index = e.turn_index + 1))
    SELECT conversation_id, turn_index, mode, source FROM e"""
)
def effective_mode(spark, sf_dir):
    return G.effective_mode(turns(spark, sf_dir).withColumnRenamed("mode", "routed_mode").withColumn("confidence", _conf()))


@query(f"SELECT conversation_id, turn_index, CASE WHEN turn_index % 2 = 0 AND coalesce(character, '') <> '' THEN character WHEN turn_index % 3 = 0 THEN 'x' END AS character, CASE WHEN turn_index % 2 = 0 AND coalesce(character, '') <> '' THEN 'inherited' WHEN turn_index % 3 = 0 THEN 'detected' ELSE 'ask' END AS how FROM {TURNS}")
def resolve_character(spark, sf_dir):
    t = turns(spark, sf_dir)
    made = G.resolve_character(F.when(t.turn_index % 2 == 0, "sticky").otherwise("router"), t.character, F.when(t.turn_index % 3 == 0, "x"))
    return t.select("conversation_id", "turn_index", made.alias("m")).select("conversation_id", "turn_index", "m.character", "m.how")


@query("SELECT conv_id, turn, CASE WHEN length(t) < 3 THEN 'short' WHEN lower(t) IN ('ok', 'yes') AND turn = 0 THEN 'terse' ELSE 'ok' END AS verdict FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Yes' WHEN 2 THEN ' a ' ELSE text END AS said, trim(CASE turn % 4 WHEN 0 THEN 'Yes' WHEN 2 THEN ' a ' ELSE text END, ' ') AS t FROM conversations)")
def input_ok(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.when(c.turn % 4 == 0, "Yes").when(c.turn % 4 == 2, " a ").otherwise(c.text)
    return c.select("conv_id", "turn", G.input_ok(said, F.when(c.turn > 0, c.conv_id)).alias("verdict"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'debate' WHEN 'click' THEN 'open_analysis' ELSE 'none' END AS mode, CASE WHEN event_id % 2 = 0 THEN props ELSE '{}' END AS kwargs, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM events")
def parse_router(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mode = F.when(e.event_type == "view", " Debate").when(e.event_type == "click", "Open-Analysis").otherwise(e.event_type)
    kwargs = F.when(e.event_id % 2 == 0, e.props).otherwise("[1]")
    made = G.parse_router(mode, kwargs, F.when(e.event_id % 3 == 0, "HIGH"))
    return e.select("event_id", made.alias("m")).select("event_id", "m.mode", "m.kwargs", "m.confidence")


_CHARS = f"(SELECT conversation_id, turn_index, length(user_message) + length(said) AS chars FROM {TURNS})"
_CURVE = f"""(SELECT conversation_id, t AS threshold, turn_index, n, CASE WHEN n > t THEN recent + 400 ELSE total END AS chars, CASE WHEN n > t THEN least(n, 2) ELSE n END AS verbatim, n > t AS has_summary FROM
 (SELECT *, row_number() OVER w AS n, sum(chars) OVER w AS total, sum(chars) OVER (PARTITION BY conversation_id ORDER BY turn_index ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS recent FROM {_CHARS} WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_index)), (VALUES (1), (2), (3)) v(t))"""


def _curve(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("chars", F.length("user_message") + F.length(F.trim("said")))
    return G.compaction_curve(t, [1, 2, 3], 2)


@query(f"SELECT conversation_id, threshold, turn_index, chars::BIGINT AS chars, verbatim, has_summary FROM {_CURVE}")
def compaction_curve(spark, sf_dir):
    return _curve(spark, sf_dir).drop("n")


@query(f"SELECT conversation_id, threshold, max(chars)::BIGINT AS max_chars, quantile_cont(chars::DOUBLE, 0.5) AS median_chars, min(chars)::BIGINT AS min_chars, arg_max(chars, turn_index)::BIGINT AS final_chars, count(*) FILTER (has_summary) AS compactions FROM {_CURVE} GROUP BY ALL")
def curve_summary(spark, sf_dir):
    return G.curve_summary(_curve(spark, sf_dir))


@query(f"SELECT conversation_id, threshold, max(chars) <= 1.3 * arg_min(chars, turn_index) AS bounded FROM {_CURVE} WHERE has_summary GROUP BY ALL")
def is_bounded(spark, sf_dir):
    return G.is_bounded(_curve(spark, sf_dir))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'FAIL (' || (props->>'$.k') || '): ' WHEN 'click' THEN 'For: ' || chr(10) || 'Against: ' || chr(10) || 'Verdict: ' ELSE replace(props, 'k', 'score') END AS answer, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS stored FROM events")
def render_answer(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mode = F.when(e.event_type == "view", "exam_grader").when(e.event_type == "click", "debate").otherwise("none")
    stored = G.stored_fields(F.concat(F.lit('{"a": '), F.when(e.event_id % 2 == 0, F.lit("1")).otherwise(F.lit("null")), F.lit("}")))
    return e.select("event_id", G.render_answer(F.replace(e.props, F.lit("k"), F.lit("score")), mode).alias("answer"), F.size(stored).alias("stored"))


def entries(spark, sf_dir):
    """Conversation rows as context entries; every third is retrieved, the first is the system's."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(c.turn == 0, "system").when(c.turn % 3 == 2, "retrieval").otherwise(c.role)
    return A.with_tokens(c.select(c.conv_id.alias("session_id"), role.alias("role"), c.text.alias("content"), (c.turn % 2).cast("double").alias("priority"), c.turn.alias("ts")))


ENTRIES = f"(SELECT conv_id AS session_id, CASE WHEN turn = 0 THEN 'system' WHEN turn % 3 = 2 THEN 'retrieval' ELSE role END AS role, text AS content, (turn % 2)::DOUBLE AS priority, turn AS ts, {count_sql('text')}::INT AS tokens FROM conversations)"


@query(f"SELECT session_id, ts, tokens FROM {ENTRIES}")
def token_count(spark, sf_dir):
    return entries(spark, sf_dir).select("session_id", "ts", "tokens")


@query(f"SELECT session_id, sum(tokens)::BIGINT AS used, 3000 - sum(tokens)::BIGINT AS remaining FROM {ENTRIES} GROUP BY session_id")
def token_budget(spark, sf_dir):
    return A.budget(entries(spark, sf_dir), 4000, 1000)


@query()
def fit_budget(spark, sf_dir):
    return A.fit_budget(entries(spark, sf_dir), 200).select("session_id", "ts", "tokens", "error")


@query()
def fit_budget_compressed(spark, sf_dir):
    first = lambda texts: " ".join(t.split()[0] if t.split() else "" for t in texts)
    return A.fit_budget(entries(spark, sf_dir), 200, compress=first, protected=("system", "retrieval")).select("session_id", "ts", "tokens", "priority", "error")


@query(f"SELECT conv_id, turn, array_to_string(({words_sql('text')})[1:3], ' ') AS said FROM conversations")
def summarised_turns(spark, sf_dir):
    beginnings = hooks.text_hook(lambda texts: [" ".join(t.split()[:3]) for t in texts])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", beginnings(F.col("text")).alias("said"))


@query(f"SELECT session_id, ts FROM {ENTRIES} WHERE role <> 'retrieval'")
def clear_retrieval(spark, sf_dir):
    return A.clear_retrieval(entries(spark, sf_dir)).select("session_id", "ts")


@query(f"SELECT session_id, 4000 AS budget, sum(tokens)::BIGINT AS used, 4000 - sum(tokens)::BIGINT AS remaining, count(*) AS entries, string_agg(role || ': ' || substr(content, 1, 80), '|' ORDER BY ts) AS previews FROM {ENTRIES} GROUP BY session_id")
def context_snapshot(spark, sf_dir):
    s = A.snapshot(entries(spark, sf_dir), 4000)
    return s.withColumn("previews", F.array_join("previews", "|"))


_OVER = f"(SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY session_id) - coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM {ENTRIES}) WHERE rest > 120)"


@query(f"SELECT session_id, ts FROM {_OVER}")
def over_budget(spark, sf_dir):
    recent, _ = A.split_budget(200)
    return A.over_budget(entries(spark, sf_dir), recent).select("session_id", "ts")


@query(f"SELECT session_id, ts, tokens FROM {ENTRIES} WHERE (session_id, ts) NOT IN (SELECT (session_id, ts) FROM {_OVER}) UNION ALL SELECT DISTINCT session_id, -1, 3 FROM {_OVER}")
def apply_summary(spark, sf_dir):
    e = entries(spark, sf_dir)
    over = A.over_budget(e, 120)
    new = over.select("session_id").distinct().withColumn("content", F.lit("Summary: in short"))
    return A.apply_summary(e, over, new).select("session_id", "ts", "tokens")


@query(f"SELECT session_id, sha256(string_agg(content, '' ORDER BY ts)) AS covered_hash, 'Summary: ' || string_agg(substr(content, 1, 80), ' | ' ORDER BY ts) AS summary FROM {ENTRIES} GROUP BY session_id")
def covered_hash_and_stub(spark, sf_dir):
    e = entries(spark, sf_dir)
    return A.covered_hash(e).join(A.stub_summary(e), "session_id")


@query(f"SELECT session_id, arg_max(content, ts) AS summary_text FROM {ENTRIES} GROUP BY session_id")
def latest_summary(spark, sf_dir):
    return A.latest_summary(entries(spark, sf_dir).select("session_id", F.col("content").alias("summary_text"), F.col("ts").alias("created_at")))


@query("SELECT doc_id, 'Ask: ' || source || chr(10) || CASE WHEN lang = 'en' THEN '' ELSE '<context>' || chr(10) || lang || chr(10) || '</context>' END || ' (all)' AS prompt FROM documents")
def render_template(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    context = A.inject_context(F.when(d.lang == "en", "").otherwise(d.lang))
    return d.select("doc_id", A.render("Ask: {{QUERY}}\n{{CONTEXT}} ({{AGE}})", {"QUERY": d.source, "CONTEXT": context}, {"AGE": "all"}).alias("prompt"))


def _messages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("summary"), F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content"))).alias("history"),
        F.lit("").alias("profile"), F.when(F.col("doc_id") % 3 == 0, F.lit("found it")).alias("retrieval"), F.lit("well?").alias("message"),
    )
    return d


@query(
    """WITH m AS (SELECT doc_id AS query_id, unnest(list_filter([{'o': 0, 'role': 'system', 'content': CASE WHEN doc_id % 2 = 0 THEN '[Conversation summary]' || chr(10) || source END}, {'o': 1, 'role': 'user', 'content': lang},
    {'o': 2, 'role': 'system', 'content': CASE WHEN doc_id % 3 = 0 THEN '[Retrieved passages]' || chr(10) || 'found it' END}, {'o': 3, 'role': 'user', 'content': 'well?'}], lambda x: x.content IS NOT NULL)) AS m FROM documents)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY m.o) - 1)::INT AS position, m.role AS role, m.content AS content FROM m"""
)
def to_messages(spark, sf_dir):
    return A.to_messages(_messages(spark, sf_dir))


@query("SELECT doc_id AS query_id, 2 + (doc_id % 2 = 0)::INT + 2 * (doc_id % 3 = 0)::INT AS tokens, CASE WHEN doc_id % 3 = 0 THEN 'found it' ELSE 'No context available.' END AS answer FROM documents")
def token_estimate_and_stub_answer(spark, sf_dir):
    m = _messages(spark, sf_dir)
    tokens = m.select("query_id", A.token_estimate(F.col("message"), F.col("summary"), F.col("retrieval"), F.col("profile"), F.array_join(F.transform("history", lambda h: h.content), " ")).alias("tokens"))
    rows = m.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("position"), F.lit("user").alias("role"), F.lit("q").alias("content")), F.struct(F.lit(1).alias("position"), F.when(m.retrieval.isNotNull(), "retrieval").otherwise("user").alias("role"), F.coalesce(m.retrieval, F.lit("")).alias("content")))).alias("m"))
    return tokens.join(A.stub_answer(rows.select("query_id", "m.position", "m.role", "m.content")), "query_id")
