"""Queries of the row scorers and run comparisons, over documents, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluate as I
from tessera.operators import hooks
from tessera.plans.base import query, table


def _answers(spark, sf_dir):
    """Documents as answers: cited tokens are words of the text, expected ones its language and source."""
    d = table(spark, sf_dir, "documents")
    answer = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("The provided context does not say. "), F.col("text"))).otherwise(F.col("text"))
    return d.select(
        "doc_id", answer.alias("answer"), F.col("text").alias("more"), F.col("text").alias("tail"),
        F.concat_ws(" ", F.col("lang"), F.col("source"), F.lit("THE")).alias("expected"), F.concat_ws(" ", F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("cited"),
        F.when(F.col("doc_id") % 9 == 0, "distractor").otherwise("easy").alias("kind"), F.element_at(F.array(F.lit("high "), F.lit("Low"), F.lit("sure")), (F.col("doc_id") % 3 + 1).cast("int")).alias("confidence"), "text", "source", "lang",
    )


_A = """(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'The provided context does not say. ' || text ELSE text END AS answer, text AS more, text AS tail,
 lang || ' ' || source || ' THE' AS expected, text || CASE WHEN doc_id % 2 = 0 THEN ' ' || source ELSE '' END AS cited,
 CASE WHEN doc_id % 9 = 0 THEN 'distractor' ELSE 'easy' END AS kind, ['high ', 'Low', 'sure'][doc_id % 3 + 1] AS confidence, text, source, lang FROM documents)"""


def _set(c):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> ''))"


_E, _C = _set("expected"), _set("cited")
_SHARED = f"len(list_intersect({_E}, {_C}))"
_MAJORITY = f"({_SHARED} >= (len({_E}) + 1) // 2)"


def _any(c, phrases):
    return "(" + " OR ".join("contains(lower({c}), '{p}')".format(c=c, p=p.replace("'", "''")) for p in phrases) + ")"


_REFUSED = _any("answer", I.REFUSAL_PHRASES)


@query(f"SELECT doc_id, array_to_string(list_sort({_E}), ' ') AS tokens FROM {_A}")
def token_set(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(I.token_set(F.col("expected"))), " ").alias("tokens"))


@query(f"SELECT doc_id, {_MAJORITY} AS majority, {_SHARED} = len({_E}) AS strict, {_REFUSED} AS refused FROM {_A}")
def citation_rules(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("doc_id", I.citation_majority(a.expected, a.cited).alias("majority"), I.citation_strict(a.expected, a.cited).alias("strict"), I.is_refusal(a.answer).alias("refused"))


@query(
    f"""SELECT doc_id, ({_MAJORITY} AND NOT ({_REFUSED} AND kind <> 'distractor') AND length(answer) >= 30) AS balanced,
    round(0.4::DOUBLE * {_SHARED} / len({_E}) + CASE WHEN (kind = 'distractor') = {_REFUSED} THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN length(answer) BETWEEN 30 AND 500 THEN 0.2::DOUBLE WHEN length(answer) > 500 THEN 0.1::DOUBLE ELSE 0 END
      + CASE WHEN lower(trim(confidence)) IN ('low', 'medium', 'high') THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM {_A}"""
)
def research_scorers(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("doc_id", I.research_balanced(a.expected, a.cited, a.answer, a.kind).alias("balanced"), F.round(I.research_score(a.expected, a.cited, a.answer, a.kind, a.confidence), 6).alias("score"))


_Q = "CASE WHEN doc_id % 2 = 0 THEN tail || '? ' ELSE tail END"
_H = "CASE WHEN doc_id % 5 = 0 THEN 'The answer is ' || more ELSE more END"


@query(
    f"""SELECT doc_id, (NOT {_any('h', I.SPOILER_PHRASES)} AND NOT {_any('answer', I.SPOILER_PHRASES)} AND q LIKE '%?' AND length(h) >= 20) AS passed,
    round(CASE WHEN h <> '' AND NOT {_any('h', I.SPOILER_PHRASES)} THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN q LIKE '%?' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN answer <> '' AND NOT {_any('answer', I.SPOILER_PHRASES)} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(h) BETWEEN 30 AND 400 THEN 0.1::DOUBLE ELSE 0 END, 6) AS score
    FROM (SELECT doc_id, answer, {_H} AS h, regexp_replace({_Q}, '\\s+$', '') AS q FROM {_A})"""
)
def socratic_scorers(spark, sf_dir):
    a = _answers(spark, sf_dir)
    hint = F.when(a.doc_id % 5 == 0, F.concat(F.lit("The answer is "), a.more)).otherwise(a.more)
    question = F.when(a.doc_id % 2 == 0, F.concat(F.col("tail"), F.lit("? "))).otherwise(F.col("tail"))
    return a.select("doc_id", I.socratic_pass(hint, question, a.answer).alias("passed"), F.round(I.socratic_score(hint, question, a.answer), 6).alias("score"))


_STOP = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(I.STOPWORDS)) + "]"


def _content(c):
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z]{{3,}}')), lambda w: NOT list_contains({_STOP}, w))"


_GREETS = "(" + " OR ".join(f"starts_with(lower(r), '{g}')" for g in I.GREETING_OPENERS) + ")"


@query(
    f"""SELECT doc_id, {_GREETS} AS greets, {_any('scenario', I.REFLECTION_TRIGGERS)} AS reflects, len({_content('answer')})::INT AS n_content,
    (length(answer) >= 50 AND length(more) >= 80 AND length(tail) >= 30 AND length(regexp_replace(r, '^\\s+|\\s+$', '', 'g')) >= 100 AND NOT {_GREETS} AND NOT ({_any('scenario', I.REFLECTION_TRIGGERS)} AND len(list_intersect({_content('answer')}, {_content('r')})) < 3)) AS passed
    FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'Hello there ' || answer ELSE answer END AS r, CASE WHEN doc_id % 3 = 0 THEN 'please recap' ELSE 'so' END AS scenario FROM {_A})"""
)
def perspective_scorers(spark, sf_dir):
    a = _answers(spark, sf_dir)
    a = a.withColumn("r", F.when(a.doc_id % 4 == 0, F.concat(F.lit("Hello there "), a.answer)).otherwise(a.answer)).withColumn("scenario", F.when(a.doc_id % 3 == 0, "please recap").otherwise("so"))
    reasoning = F.concat(F.col("tail"), F.lit("." * 20))
    return a.select(
        "doc_id", I.opens_greeting(F.col("r")).alias("greets"), I.is_reflection(F.col("scenario")).alias("reflects"), F.size(I.content_words(F.col("answer"))).alias("n_content"),
        I.perspective_pass(F.col("answer"), F.col("more"), reasoning, F.col("r"), F.col("cited"), F.col("answer"), F.col("scenario")).alias("passed"),
    )


@query("SELECT d.doc_id, (length(text) >= 100 AND length(source) >= 4 AND length(lang) >= 2 AND length(text) >= 30 AND length(text) >= 20) AS analysis, (abs(quality * 20 - toxic * 10 - 10) <= 15 AND (toxic = 1) = (quality = 1) AND length(text) >= 20) AS graded FROM documents d JOIN labels USING (doc_id)")
def analysis_and_grader(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        "doc_id", I.analysis_pass(d.text, F.col("text"), F.col("text")).alias("analysis"),
        I.grader_pass(d.quality * 20, d.toxic * 10 + 10, d.toxic == 1, d.quality == 1, F.col("text")).alias("graded"),
    )


_SPOKEN = r"len(regexp_extract_all(regexp_replace(t, '^\s+|\s+$', '', 'g'), '(?m)^\s*\w[\w\s]*:\s+\S'))"
_T = "(SELECT doc_id, answer, more, tail, 'Host: ' || answer || chr(10) || 'Guest: ' || more || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Host: ok' ELSE '' END AS t, expected, cited, CASE WHEN doc_id % 5 = 0 THEN 'None ' ELSE cited END AS named FROM " + _A + ")"
_NAMED = "(lower(regexp_replace(named, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'none'))"
_LEN = lambda c: f"length(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


@query(
    f"""SELECT doc_id, ({_LEN('t')} >= 150 AND {_SPOKEN} >= 3 AND {_LEN('tail')} >= 20 AND {_NAMED}) AS podcast,
    round(CASE WHEN {_LEN('t')} >= 150 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {_SPOKEN} >= 3 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {_LEN('tail')} >= 20 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {_NAMED} THEN 0.2::DOUBLE ELSE 0 END, 6) AS podcast_score,
    ({_LEN('answer')} >= 20 AND {_LEN('more')} >= 20 AND {_LEN('tail')} >= 10 AND {_SHARED} > 0) AS debate,
    round(CASE WHEN {_LEN('answer')} >= 20 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {_LEN('more')} >= 20 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {_LEN('tail')} >= 10 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {_SHARED} > 0 THEN 0.2::DOUBLE ELSE 0 END, 6) AS debate_score FROM {_T}"""
)
def podcast_and_debate(spark, sf_dir):
    a = _answers(spark, sf_dir)
    t = F.concat(F.lit("Host: "), a.answer, F.lit("\nGuest: "), a.more, F.when(a.doc_id % 2 == 0, F.lit("\nHost: ok")).otherwise(F.lit("")))
    named = F.when(a.doc_id % 5 == 0, F.lit("None ")).otherwise(a.cited)
    return a.select(
        "doc_id", I.podcast_pass(t, F.col("tail"), named).alias("podcast"), F.round(I.podcast_score(t, F.col("tail"), named), 6).alias("podcast_score"),
        I.debate_pass(a.answer, a.more, F.col("tail"), a.expected, a.cited).alias("debate"), F.round(I.debate_score(a.answer, a.more, F.col("tail"), a.expected, a.cited), 6).alias("debate_score"),
    )


_KIND = "CASE WHEN event_id % 6 = 0 THEN 'other' ELSE event_type END"


@query(
    f"""SELECT event_id, ({_KIND} = event_type AND event_id % 5 <> 0) AS passed,
    round(CASE WHEN {_KIND} = event_type THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN event_id % 5 <> 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0 END, 6) AS score FROM events"""
)
def router_scorers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mode = F.when(e.event_id % 6 == 0, "other").otherwise(F.concat(F.lit(" "), F.upper("event_type")))
    kwargs = F.when(e.event_id % 10 == 0, F.lit("not json")).when(e.event_id % 10 == 5, F.lit('{"j": 1}')).otherwise(e.props)
    confidence = F.when(e.event_id % 2 == 0, " High").otherwise("sure")
    return e.select("event_id", I.router_pass(e.event_type, mode, e.props, kwargs).alias("passed"), F.round(I.router_score(e.event_type, mode, e.props, kwargs, confidence), 6).alias("score"))


@query("SELECT e.event_type AS mode, round(avg((value > 20)::INT), 6) AS pass_rate, t.threshold::DOUBLE AS threshold, avg((value > 20)::INT) >= t.threshold AS ok FROM events e JOIN (VALUES ('view', 0.3), ('click', 0.9), ('error', 0.5)) t(mode, threshold) ON e.event_type = t.mode GROUP BY e.event_type, t.threshold UNION ALL SELECT 'absent', 0, 0.1::DOUBLE, false")
def slo_check(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), (F.col("value") > 20).alias("passed"))
    limits = spark.createDataFrame([("view", 0.3), ("click", 0.9), ("error", 0.5), ("absent", 0.1)], "mode string, threshold double")
    return I.slo_check(rows, limits).withColumn("pass_rate", F.round("pass_rate", 6))


def _runs(spark, sf_dir):
    """Events as evaluation rows: a label and run by user, a question by k."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(e.user_id % 2 == 0, "before").otherwise("after").alias("run_label"), (e.user_id % 6).alias("run"), e.event_id.alias("id"), e.event_type.alias("kind"), (e.value > F.when(e.user_id % 2 == 0, 20).otherwise(15)).alias("correct"),
        (e.value / 10).alias("latency_s"), (F.when(e.value > 60, 1).otherwise(0)).alias("retries"), F.get_json_object("props", "$.k").alias("q"), F.when(e.event_id % 3 > 0, e.event_id % 3 == 1).alias("retrieval_hit"), (e.event_id % 4).alias("calls"), e.event_id.alias("tokens"), e.value.alias("cost_usd"),
    )


_R = """(SELECT CASE WHEN user_id % 2 = 0 THEN 'before' ELSE 'after' END AS run_label, user_id % 6 AS run, event_id AS id, event_type AS kind, value > CASE WHEN user_id % 2 = 0 THEN 20 ELSE 15 END AS correct, value / 10 AS latency_s,
 CASE WHEN value > 60 THEN 1 ELSE 0 END AS retries, props->>'$.k' AS q, CASE WHEN event_id % 3 > 0 THEN event_id % 3 = 1 END AS retrieval_hit, event_id % 4 AS calls, event_id AS tokens, value AS cost_usd FROM events)"""


@query(f"SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS n, round(avg(correct::INT), 6) AS correct_rate, round(avg(retrieval_hit::INT), 6) AS hit_rate, round(avg(calls), 6) AS mean_calls, sum(tokens)::BIGINT AS tokens, round(sum(cost_usd), 4) AS cost_usd FROM {_R} GROUP BY GROUPING SETS ((), (kind))")
def run_summary(spark, sf_dir):
    return I.run_summary(_runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("correct_rate", "hit_rate", "mean_calls")}).withColumn("cost_usd", F.round("cost_usd", 4))


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY run_label, run ORDER BY id) AS n FROM {_R}),
    r AS (SELECT run_label, run, avg(correct::INT) AS accuracy, sum(latency_s) FILTER (n > 1) AS lat, count(*) FILTER (n > 1) AS n_lat, sum((retries > 0)::INT) AS retried, count(*) AS n FROM n GROUP BY run_label, run)
    SELECT run_label, round(avg(accuracy), 6) AS mean_accuracy, round(coalesce(stddev_samp(accuracy), 0), 6) AS std_accuracy, count(*) AS runs, round(sum(lat) / sum(n_lat), 6) AS mean_latency_s, round(sum(retried)::DOUBLE / sum(n), 6) AS retry_rate FROM r GROUP BY run_label"""
)
def multi_run_summary(spark, sf_dir):
    return I.multi_run_summary(_runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_accuracy", "std_accuracy", "mean_latency_s", "retry_rate")})


_RATES = f"(SELECT run_label, kind, q AS id, avg(correct::INT) AS rate FROM {_R} GROUP BY ALL)"


@query(f"SELECT run_label, kind, id, round(rate, 6) AS rate, round(avg(rate) OVER (PARTITION BY run_label, kind), 6) AS kind_rate FROM {_RATES}")
def question_rates(spark, sf_dir):
    rows = _runs(spark, sf_dir).withColumn("id", F.col("q"))
    return I.question_rates(rows).withColumns({c: F.round(c, 6) for c in ("rate", "kind_rate")})


_SIDE = lambda label: f"(SELECT q AS id, avg(correct::INT) AS rate FROM {_R} WHERE run_label = '{label}' GROUP BY q)"
_COMPARED = f"(SELECT coalesce(b.id, a.id) AS id, b.rate AS was, a.rate AS now, coalesce(a.rate, 0) - coalesce(b.rate, 0) AS delta FROM {_SIDE('before')} b FULL JOIN {_SIDE('after')} a ON a.id = b.id)"


def _compared(spark, sf_dir):
    rows = _runs(spark, sf_dir).groupBy("run_label", F.col("q").alias("id")).agg(F.avg(F.col("correct").cast("double")).alias("rate"))
    return I.compare_runs(rows.filter("run_label = 'before'"), rows.filter("run_label = 'after'"))


@query(f"SELECT id, round(was, 6) AS was, round(now, 6) AS now, round(delta, 6) AS delta, CASE WHEN delta > 0.01 THEN 'improved' WHEN delta < -0.01 THEN 'regressed' ELSE 'same' END AS verdict FROM {_COMPARED}")
def compare_runs(spark, sf_dir):
    return _compared(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("was", "now", "delta")})


@query(f"SELECT round(d, 6) AS delta, improved, regressed, CASE WHEN d >= 0.05 THEN 'better' WHEN d <= -0.05 THEN 'worse' ELSE 'neutral' END AS verdict FROM (SELECT avg(coalesce(now, 0)) - avg(coalesce(was, 0)) AS d, count(*) FILTER (delta > 0.01) AS improved, count(*) FILTER (delta < -0.01) AS regressed FROM {_COMPARED})")
def run_verdict(spark, sf_dir):
    return I.run_verdict(_compared(spark, sf_dir)).withColumn("delta", F.round("delta", 6))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN contains(lower(text), 'not say') OR doc_id % 18 = 0 ELSE doc_id % 2 = 0 AND doc_id % 4 <> 2 END AS correct FROM documents")
def judge_by_kind(spark, sf_dir):
    a = _answers(spark, sf_dir)
    answer = F.when(a.doc_id % 18 == 0, F.lit("I don't know it.")).otherwise(a.text)
    reply = F.when(a.doc_id % 2 == 0, F.concat(F.lit('So: {"correct": '), F.when(a.doc_id % 4 == 2, F.lit("false")).otherwise(F.lit("true")), F.lit(', "reason": "x"} ok'))).otherwise(F.lit("no json"))
    return I.judge(a.select("doc_id", "kind", answer.alias("answer"), reply.alias("reply")), "reply").select("doc_id", "correct")


@query("SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1")
def split_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return I.split_overlap(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_train, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_held_out, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) >= 15 AND (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) >= 15 AS enough")
def split_sizes(spark, sf_dir):
    d, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    return I.split_sizes(d.join(known, "doc_id", "left_anti"), d.join(known, "doc_id", "left_semi"), 15, 15)


@query("SELECT band, n, n > 0 AS covered FROM (SELECT 'very low' AS band, count(*) FILTER (n_chars <= 20) AS n FROM documents UNION ALL SELECT 'middle', count(*) FILTER (n_chars BETWEEN 40 AND 70) FROM documents UNION ALL SELECT 'high', count(*) FILTER (n_chars >= 80) FROM documents)")
def class_spread(spark, sf_dir):
    return I.class_spread(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT doc_id, contains(text, source) AS correct, CASE WHEN contains(text, source) THEN 'named' ELSE 'not named' END AS reason FROM documents")
def judged_answers(spark, sf_dir):
    def judge(frame):
        found = [(str(r) in str(a)) for a, r in zip(frame["answer"], frame["reference"])]
        return [(x, "named" if x else "not named") for x in found]

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", hooks.judge_hook(judge)(F.col("lang"), F.col("text"), F.col("source")).alias("v")).select("doc_id", "v.correct", "v.reason")


@query("SELECT doc_id AS id, doc_id + 5 AS doc_id FROM labels WHERE doc_id + 5 NOT IN (SELECT doc_id FROM labels)")
def unknown_citations(spark, sf_dir):
    known = table(spark, sf_dir, "labels")
    return I.unknown_citations(known.select(F.col("doc_id").alias("id"), F.array(F.col("doc_id"), F.col("doc_id") + 5).alias("expected_docs")), known)


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, count(*) AS n, round(sum(value), 4) AS cost_usd, sum(length(props))::BIGINT AS chars, round(sum(value), 4) AS latency_ms FROM events GROUP BY 1")
def ab_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("arm"), F.col("value").alias("cost_usd"), F.length("props").alias("chars"), F.col("value").alias("latency_ms"))
    return I.ab_totals(e).withColumns({c: F.round(c, 4) for c in ("cost_usd", "latency_ms")})


@query(f"SELECT id, correct, retrieval_hit FROM {_R} WHERE retrieval_hit IS NOT NULL AND correct <> retrieval_hit")
def disagreements(spark, sf_dir):
    return I.disagreements(_runs(spark, sf_dir)).select("id", "correct", "retrieval_hit")


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 = 1 END AS retrieval_hit, (contains('src1', source) OR contains(source, 'src1')) AS fuzzy FROM documents")
def transcript_and_fuzzy_hit(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", "source", F.array(F.array(F.lit("x")), F.array(F.col("lang"), F.col("source"))).alias("calls"), F.when(d.doc_id % 3 == 0, F.array().cast("array<string>")).when(d.doc_id % 3 == 1, F.array("source")).otherwise(F.array(F.lit("none"))).alias("expected_docs"))
    return I.transcript_hit(d).select("doc_id", "retrieval_hit", I.fuzzy_hit(F.array("source"), F.array(F.lit("src1"))).alias("fuzzy"))
