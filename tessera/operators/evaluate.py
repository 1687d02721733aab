"""Evaluation: retrieval metrics, row scorers as native column expressions, run summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import join_checked

#: Phrases by which an answer declines.
REFUSAL_PHRASES = (
    "context does not contain",
    "text does not contain",
    "i don't know",
    "information is not available",
    "answer is not available",
    "cannot answer",
    "no information about",
    "not mentioned in the",
    "i'm sorry, but the provided",
    "the provided context does not",
)
#: Phrases that give an answer away.
SPOILER_PHRASES = (
    "the answer is",
    "this is because",
    "voldemort is",
    "dumbledore is",
    "a horcrux is",
    "the deathly hallows are",
    "the elder wand is",
    "the invisibility cloak is",
    "the resurrection stone is",
)
#: Openers of a greeting; phrases that ask for a summary.
GREETING_OPENERS = ("oh, hello", "hi there", "hello there", "hello,", "hi,", "welcome", "nice to meet")
REFLECTION_TRIGGERS = (
    "summarize",
    "summarise",
    "what have i told you",
    "what did i tell you",
    "what did i say",
    "what have i said",
    "reflect back",
    "recap",
    "my situation",
    "what do you know about me",
)
#: Words without content.
STOPWORDS = (
    "i me my you your a an the is am are was were be been being "
    "do does did have has had it its in on at to for of and or but "
    "not no so if by with from that this these those than then "
    "about just really very also too all both each "
    "what when where who how which why would could should can may "
    "will shall might must well most more some any our her him his "
    "them they she he we us them into out up even still yet"
).split()
CONFIDENCES = ("low", "medium", "high")
#: Least pass rates of the modes.
SLO_THRESHOLDS = {"deep_research": 0.80, "guided_learning": 0.60, "open_analysis": 0.60, "exam_grader": 0.80, "perspective_shift": 0.60, "debate": 0.60, "satirical_podcast": 0.70, "intent_router": 0.60}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _trimmed(c: Column) -> Column:
    return T.strip(_text(c))


def _any_in(text: Column, phrases) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def token_set(c: Column) -> Column:
    """Distinct lower-case tokens of a citation string."""
    return F.array_distinct(F.filter(F.split(F.lower(_text(c)), r"\s+"), lambda t: t != ""))


def _overlap(expected: Column, found: Column) -> Column:
    return F.size(F.array_intersect(token_set(expected), token_set(found)))


def citation_majority(expected: Column, found: Column) -> Column:
    """At least half of the expected citations, rounded up; true if none is expected."""
    n = F.size(token_set(expected))
    return (n == 0) | (_overlap(expected, found) >= F.floor((n + 1) / 2))


def citation_strict(expected: Column, found: Column) -> Column:
    """All expected citations."""
    return F.size(F.array_except(token_set(expected), token_set(found))) == 0


def is_refusal(answer: Column) -> Column:
    """Whether an answer declines."""
    return _any_in(F.lower(_text(answer)), REFUSAL_PHRASES)


def research_balanced(expected: Column, found: Column, answer: Column, kind: Column) -> Column:
    """Enough citations, no refusal unless the question is a distractor, 30 characters."""
    return citation_majority(expected, found) & ~(is_refusal(answer) & (kind != "distractor")) & (F.length(_text(answer)) >= 30)


def research_score(expected: Column, found: Column, answer: Column, kind: Column, confidence: Column) -> Column:
    """0.4 for the share of citations, 0.3 for a fitting refusal or answer, 0.2 for length (0.1 over 500), 0.1 for confidence."""
    n = F.size(token_set(expected))
    cited = F.when(n == 0, 0.4).otherwise(0.4 * _overlap(expected, found) / n)
    fits = F.when((kind == "distractor") == is_refusal(answer), 0.3).otherwise(0.0)
    length = F.length(_text(answer))
    size = F.when(length.between(30, 500), 0.2).when(length > 500, 0.1).otherwise(0.0)
    sure = F.when(F.lower(F.trim(_text(confidence))).isin(*CONFIDENCES), 0.1).otherwise(0.0)
    return cited + fits + size + sure


def _spoils(c: Column, phrases: tuple[str, ...]) -> Column:
    return _any_in(F.lower(_text(c)), phrases)


def socratic_pass(hint: Column, question: Column, explanation: Column, phrases: tuple[str, ...] = SPOILER_PHRASES) -> Column:
    """None of the ``phrases`` that give an answer away, a question mark, a hint of 20 characters."""
    return ~_spoils(hint, phrases) & ~_spoils(explanation, phrases) & F.endswith(_trimmed(question), F.lit("?")) & (F.length(_text(hint)) >= 20)


def socratic_score(hint: Column, question: Column, explanation: Column, phrases: tuple[str, ...] = SPOILER_PHRASES) -> Column:
    """0.4, 0.3, 0.2 and 0.1 for hint, question, explanation and length."""
    return (
        F.when((_text(hint) != "") & ~_spoils(hint, phrases), 0.4).otherwise(0.0)
        + F.when(F.endswith(_trimmed(question), F.lit("?")), 0.3).otherwise(0.0)
        + F.when((_text(explanation) != "") & ~_spoils(explanation, phrases), 0.2).otherwise(0.0)
        + F.when(F.length(_text(hint)).between(30, 400), 0.1).otherwise(0.0)
    )


def opens_greeting(c: Column) -> Column:
    """Whether a text opens with a greeting."""
    start = F.lower(F.regexp_replace(_text(c), r"^\s+", ""))
    return F.exists(F.array(*[F.lit(g) for g in GREETING_OPENERS]), lambda g: F.startswith(start, g))


def is_reflection(c: Column) -> Column:
    """Whether a text asks for a summary."""
    return _any_in(F.lower(_text(c)), REFLECTION_TRIGGERS)


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*[F.lit(w) for w in STOPWORDS]))


def perspective_pass(principle: Column, insight: Column, reasoning: Column, response: Column, citations: Column, history: Column, scenario: Column) -> Column:
    """Lengths 50, 80, 50 and 100, citations, no greeting within a chat, three shared content words on reflection."""
    going = _trimmed(history) != ""
    shared = F.size(F.array_intersect(content_words(history), content_words(response)))
    return (
        (F.length(_text(principle)) >= 50)
        & (F.length(_text(insight)) >= 80)
        & (F.length(_text(reasoning)) >= 50)
        & (F.length(_trimmed(response)) >= 100)
        & ~_trimmed(citations).isin("", "none")
        & ~(going & opens_greeting(response))
        & ~(going & is_reflection(scenario) & (shared < 3))
    )


def analysis_pass(analysis: Column, reasoning: Column, facts: Column) -> Column:
    """Lengths 100, 30 and 20."""
    return (F.length(_text(analysis)) >= 100) & (F.length(_text(reasoning)) >= 30) & (F.length(_text(facts)) >= 20)


def grader_pass(expected: Column, found: Column, expected_passing: Column, passing: Column, critique: Column) -> Column:
    """Scores at most 15 apart, the same verdict where one is expected, a critique of 20 characters."""
    same = expected_passing.isNull() | (expected_passing == F.coalesce(passing, F.lit(False)))
    return (F.abs(F.coalesce(found, F.lit(0)) - F.coalesce(expected, F.lit(0))) <= 15) & same & (F.length(_text(critique)) >= 20)


def _spoken(c: Column) -> Column:
    return F.regexp_count(_trimmed(c), F.lit(r"(?m)^\s*\w[\w\s]*:\s+\S"))


def podcast_pass(transcript: Column, tension: Column, citations: Column) -> Column:
    """150 characters, three spoken lines, a tension of 20 characters, citations."""
    return (F.length(_trimmed(transcript)) >= 150) & (_spoken(transcript) >= 3) & (F.length(_trimmed(tension)) >= 20) & ~F.lower(_trimmed(citations)).isin("", "none")


def podcast_score(transcript: Column, tension: Column, citations: Column) -> Column:
    """0.3, 0.3, 0.2 and 0.2."""
    return (
        F.when(F.length(_trimmed(transcript)) >= 150, 0.3).otherwise(0.0)
        + F.when(_spoken(transcript) >= 3, 0.3).otherwise(0.0)
        + F.when(F.length(_trimmed(tension)) >= 20, 0.2).otherwise(0.0)
        + F.when(~F.lower(_trimmed(citations)).isin("", "none"), 0.2).otherwise(0.0)
    )


def debate_pass(pro: Column, con: Column, verdict: Column, expected: Column, citations: Column) -> Column:
    """20, 20 and 10 characters, and one expected citation if any is."""
    cited = (F.size(token_set(expected)) == 0) | (_overlap(expected, citations) > 0)
    return (F.length(_trimmed(pro)) >= 20) & (F.length(_trimmed(con)) >= 20) & (F.length(_trimmed(verdict)) >= 10) & cited


def debate_score(pro: Column, con: Column, verdict: Column, expected: Column, citations: Column) -> Column:
    """0.3, 0.3, 0.2 and 0.2."""
    return (
        F.when(F.length(_trimmed(pro)) >= 20, 0.3).otherwise(0.0)
        + F.when(F.length(_trimmed(con)) >= 20, 0.3).otherwise(0.0)
        + F.when(F.length(_trimmed(verdict)) >= 10, 0.2).otherwise(0.0)
        + F.when(_overlap(expected, citations) > 0, 0.2).otherwise(0.0)
    )


def _keys(c: Column) -> Column:
    return F.when(F.startswith(_trimmed(c), F.lit("{")), F.json_object_keys(_trimmed(c)))


def _mode(c: Column) -> Column:
    return F.regexp_replace(F.lower(_trimmed(c)), "[ -]", "_")


def router_pass(expected_mode: Column, mode: Column, expected_kwargs: Column, kwargs: Column) -> Column:
    """The mode, a JSON object, and in it the expected keys."""
    missing = F.size(F.array_except(F.coalesce(_keys(expected_kwargs), F.array().cast("array<string>")), _keys(kwargs)))
    return (_mode(mode) == F.lower(_trimmed(expected_mode))) & F.coalesce(_keys(kwargs).isNotNull() & (missing == 0), F.lit(False))


def router_score(expected_mode: Column, mode: Column, expected_kwargs: Column, kwargs: Column, confidence: Column) -> Column:
    """0.6 for the mode, 0.2 for the keys, 0.2 for a valid confidence."""
    missing = F.size(F.array_except(F.coalesce(_keys(expected_kwargs), F.array().cast("array<string>")), _keys(kwargs)))
    return (
        F.when(_mode(mode) == F.lower(_trimmed(expected_mode)), 0.6).otherwise(0.0)
        + F.when(F.coalesce(_keys(kwargs).isNotNull() & (missing == 0), F.lit(False)), 0.2).otherwise(0.0)
        + F.when(F.lower(_trimmed(confidence)).isin(*CONFIDENCES), 0.2).otherwise(0.0)
    )


def holders(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "id", item_text: str = "question", window: int = 4) -> DataFrame:
    """``(item_id, doc_id)``: the documents that hold an item's text as it is.

    The words within an item, without its first and last, stand whole in a document that holds it: hashes of up to
    ``window`` of them find the candidates, which are then searched. Items of fewer than three words are searched in
    every document.
    """
    asked = items.select(item_id, F.col(item_text).alias("item"), T.words(F.col(item_text)).alias("w")).filter("length(item) > 0")
    asked = asked.withColumn("n", F.least(F.greatest(F.size("w") - 2, F.lit(0)), F.lit(window)))
    sizes = sorted(r[0] for r in asked.select("n").distinct().collect())
    texts = docs.select(doc_id, F.col(doc_text).alias("held"))
    found = []
    for n in sizes:
        own = asked.filter(F.col("n") == n)
        if n:
            cut = lambda w, n=n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
            windows = texts.select(doc_id, "held", T.words(F.col("held")).alias("w")).filter(F.size("w") >= n)
            windows = windows.select(doc_id, "held", F.explode(F.array_distinct(T.let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: cut(h)))).alias("h"))
            keyed = own.select(item_id, "item", F.xxhash64(*[F.xxhash64(F.get("w", F.lit(1 + k))) for k in range(n)]).alias("h"))
            met = join_checked(windows, keyed, "h").filter(F.contains("held", "item"))
        else:
            met = texts.join(own, F.contains("held", "item"))
        found.append(met.select(item_id, doc_id))
    out = found[0] if found else items.select(item_id).limit(0).join(docs.select(doc_id), F.lit(False))
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def hit_recall(retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """``(id, kind, hit, recall)`` from ``retrieved(id, doc_id)`` and ``questions(id, kind, expected_docs)``.

    A distractor hits and recalls; a question that expects nothing recalls.
    """
    got = retrieved.groupBy("id").agg(F.collect_set("doc_id").alias("got"))
    rows = questions.join(got, "id", "left")
    none = F.array().cast(questions.schema["expected_docs"].dataType)
    found = F.size(F.array_intersect("expected_docs", F.coalesce("got", none)))
    n = F.size("expected_docs")
    free = F.col("kind") == "distractor"
    return rows.select("id", "kind", (free | (found > 0)).alias("hit"), F.when(free | (n == 0), 1.0).otherwise(found / n).alias("recall"), "expected_docs", F.coalesce("got", none).alias("got"))


def summarise_strategy(scored: DataFrame, key: str = "strategy") -> DataFrame:
    """Hit rate and mean recall without distractors, tokens over all."""
    real = F.col("kind") != "distractor"
    return scored.groupBy(key).agg(F.avg(F.when(real, F.col("hit").cast("double"))).alias("hit_rate"), F.avg(F.when(real, F.col("recall"))).alias("recall"), F.avg("tokens").alias("tokens"), F.count("*").alias("n"))


def misses(scored: DataFrame) -> DataFrame:
    """Rows without a hit."""
    return scored.filter(~F.col("hit"))


def first_match_rank(ranked: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """``(query_id, rank, hit5, hit10, reciprocal)``: the rank of the first result whose name holds the pattern, in any case."""
    joined = ranked.join(queries.select(key, "pattern"), key)
    rows = joined.groupBy(key).agg(F.min(F.when(F.contains(F.lower("name"), F.lower("pattern")), F.col("rank"))).alias("rank"))
    out = queries.select(key).join(rows, key, "left")
    return out.select(key, "rank", F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("hit5"), F.coalesce(F.col("rank") <= 10, F.lit(False)).alias("hit10"), F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal"))


def retrieval_metrics(ranks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Recall@5, recall@10 and MRR@10."""
    mrr = F.avg(F.when(F.col("hit10"), F.col("reciprocal")).otherwise(0.0))
    return ranks.groupBy(*(keys or [])).agg(F.avg(F.col("hit5").cast("double")).alias("recall_at_5"), F.avg(F.col("hit10").cast("double")).alias("recall_at_10"), mrr.alias("mrr_at_10"), F.count("*").alias("n"))


def rank_delta(before: DataFrame, after: DataFrame, key: str = "query_id") -> DataFrame:
    """How each query fared between two runs: improved, held (one place, both in the top five), regressed or unchanged miss."""
    rows = before.select(key, F.col("rank").alias("was")).join(after.select(key, F.col("rank").alias("now")), key, "full")
    was, now = F.col("was"), F.col("now")
    verdict = (
        F.when(was.isNull() & now.isNull(), "unchanged miss")
        .when(was.isNull(), "improved")
        .when(now.isNull(), "regressed")
        .when((F.abs(was - now) <= 1) & (was <= 5) & (now <= 5), "held")
        .when(now < was, "improved")
        .when(now > was, "regressed")
        .otherwise("held")
    )
    return rows.select(key, "was", "now", verdict.alias("verdict"))


def slo_check(rows: DataFrame, thresholds: DataFrame, mode: str = "mode", passed: str = "passed") -> DataFrame:
    """``(mode, pass_rate, threshold, ok)`` for each mode with a threshold; a mode without rows has rate 0."""
    rate = rows.groupBy(mode).agg(F.avg(F.col(passed).cast("double")).alias("pass_rate"))
    out = thresholds.join(rate, mode, "left")
    return out.select(mode, F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"), "threshold", (F.coalesce("pass_rate", F.lit(0.0)) >= F.col("threshold")).alias("ok"))


def run_summary(rows: DataFrame) -> DataFrame:
    """Overall and by kind: correct rate, hit rate where known, mean calls, tokens and cost."""
    out = rows.groupingSets([[], ["kind"]], "kind").agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("correct_rate"), F.avg(F.col("retrieval_hit").cast("double")).alias("hit_rate"),
        F.avg("calls").alias("mean_calls"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.grouping("kind").alias("g"),
    )
    return out.withColumn("kind", F.when(F.col("g") == 1, "all").otherwise(F.col("kind"))).drop("g")


def transcript_hit(rows: DataFrame, calls: str = "calls", expected: str = "expected_docs") -> DataFrame:
    """``retrieval_hit`` from nested tool calls (array of arrays of ids); null when nothing is expected."""
    return rows.withColumn("retrieval_hit", F.when(F.size(expected) > 0, F.arrays_overlap(F.flatten(calls), F.col(expected))))


def fuzzy_hit(found: Column, expected: Column) -> Column:
    """Whether some found string holds an expected one, or the other way round."""
    return F.exists(found, lambda x: F.exists(expected, lambda y: F.contains(x, y) | F.contains(y, x)))


def multi_run_summary(rows: DataFrame, order: str = "id") -> DataFrame:
    """Of each label: mean and sample deviation of the runs' accuracy, retry rate, latency without each run's first row."""
    first = F.row_number().over(W.partitionBy("run_label", "run").orderBy(order))
    runs = rows.withColumn("__n", first).groupBy("run_label", "run").agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.sum(F.when(F.col("__n") > 1, F.col("latency_s"))).alias("lat"), F.count(F.when(F.col("__n") > 1, 1)).alias("n_lat"),
        F.sum((F.col("retries") > 0).cast("int")).alias("retried"), F.count("*").alias("n"),
    )
    return runs.groupBy("run_label").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("std_accuracy"), F.count("*").alias("runs"),
        (F.sum("lat") / F.sum("n_lat")).alias("mean_latency_s"), (F.sum("retried") / F.sum("n")).alias("retry_rate"),
    )


def question_rates(rows: DataFrame) -> DataFrame:
    """Correct rate of each question over the runs, and the mean of those by kind on each row."""
    rates = rows.groupBy("run_label", "kind", "id").agg(F.avg(F.col("correct").cast("double")).alias("rate"))
    return rates.withColumn("kind_rate", F.avg("rate").over(W.partitionBy("run_label", "kind")))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of each question: rates of two runs, their difference and whether it improved or regressed by more than 0.01."""
    rows = before.select("id", F.col("rate").alias("was")).join(after.select("id", F.col("rate").alias("now")), "id", "full")
    delta = F.coalesce("now", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))
    return rows.select("id", "was", "now", delta.alias("delta"), F.when(delta > 0.01, "improved").when(delta < -0.01, "regressed").otherwise("same").alias("verdict"))


def run_verdict(compared: DataFrame) -> DataFrame:
    """Mean difference, with a verdict at 0.05 either way."""
    delta = F.avg(F.coalesce("now", F.lit(0.0))) - F.avg(F.coalesce("was", F.lit(0.0)))
    return compared.agg(delta.alias("delta"), F.count_if(F.col("verdict") == "improved").alias("improved"), F.count_if(F.col("verdict") == "regressed").alias("regressed"), F.when(delta >= 0.05, "better").when(delta <= -0.05, "worse").otherwise("neutral").alias("verdict"))


def judge(rows: DataFrame, reply: str | None = None) -> DataFrame:
    """``correct`` by kind: a distractor by whether the answer declines, others by the first JSON object in ``reply``; false if there is none."""
    found = F.from_json(F.regexp_extract(_text(F.col(reply)) if reply else F.lit(""), r"(?s)\{.*\}", 0), "correct boolean, reason string")
    return rows.withColumn("correct", F.when(F.col("kind") == "distractor", is_refusal(F.col("answer"))).otherwise(F.coalesce(found["correct"], F.lit(False))))


def split_overlap(train: DataFrame, held_out: DataFrame, key: str = "text") -> DataFrame:
    """Inputs that are in both parts."""
    return train.select(key).intersect(held_out.select(key))


def split_sizes(train: DataFrame, held_out: DataFrame, least_train: int = 15, least_held_out: int = 1) -> DataFrame:
    """Rows of both parts, and whether there are enough."""
    both = train.agg(F.count("*").alias("n_train")).join(held_out.agg(F.count("*").alias("n_held_out")), F.lit(True))
    return both.withColumn("enough", (F.col("n_train") >= least_train) & (F.col("n_held_out") >= least_held_out))


#: Score bands of which an evaluation set should have rows, both ends included.
BANDS = {"very low": (None, 20), "middle": (40, 70), "high": (80, None)}


def class_spread(rows: DataFrame, value: str, bands: dict[str, tuple] = BANDS) -> DataFrame:
    """``(band, n, covered)`` for each band of a value."""
    c = F.col(value)
    inside = lambda low, high: (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
    counts = rows.agg(*[F.count_if(inside(*ends)).alias(band) for band, ends in bands.items()])
    return counts.unpivot([], list(bands), "band", "n").withColumn("covered", F.col("n") > 0)


def unknown_citations(rows: DataFrame, docs: DataFrame, citations: str = "expected_docs") -> DataFrame:
    """``(id, doc_id)`` of citations of unknown documents."""
    return rows.select("id", F.explode(citations).alias("doc_id")).join(docs.select("doc_id").distinct(), "doc_id", "left_anti")


def ab_totals(rows: DataFrame, arm: str = "arm") -> DataFrame:
    """Cost, characters and latency of each arm."""
    return rows.groupBy(arm).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"), F.sum("chars").alias("chars"), F.sum("latency_ms").alias("latency_ms"))


def disagreements(rows: DataFrame) -> DataFrame:
    """Rows on which correctness and retrieval hit differ."""
    return rows.filter(F.col("retrieval_hit").isNotNull() & (F.col("correct") != F.col("retrieval_hit")))
