"""Conversation logs: indexes, history, compaction, costs, routing.

A turn has conversation_id, turn_index (from 1), user_message, agent_response (JSON), mode, character, tokens_in,
tokens_out, cost_usd and ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

THRESHOLD, KEEP_RECENT = 8, 5
MODES = ("deep_research", "guided_learning", "exam_grader", "open_analysis", "perspective_shift", "debate", "satirical_podcast", "none")
#: One-word inputs that say too little.
TERSE_WORDS = ("nothing", "hmm", "ok", "okay", "idk", "nah", "yeah", "sure", "no", "yes")
#: Fields that outlast a turn, by mode and else in this order.
DURABLE_FIELDS = ("character_response", "analysis", "answer", "explanation")
#: The character that stands for none.
DEFAULT_CHARACTER = "Dumbledore"


def assign_turns(log: DataFrame, new: DataFrame, order: list[str], key: str = "conversation_id") -> DataFrame:
    """``new`` with turn indexes that go on from the log's highest, from 1."""
    last = log.groupBy(key).agg(F.max("turn_index").alias("__last"))
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return new.join(last, key, "left").withColumn("turn_index", F.coalesce("__last", F.lit(0)) + n).drop("__last")


def load_history(turns: DataFrame, summaries: DataFrame, n: int = 5, key: str = "conversation_id") -> DataFrame:
    """``(conversation_id, summary, turns)``: the newest summary and the last ``n`` turns after what it covers, oldest first."""
    newest = summaries.groupBy(key).agg(F.max_by("summary", "up_to_turn").alias("summary"), F.max("up_to_turn").alias("up_to_turn"))
    rows = turns.join(newest.select(key, "up_to_turn"), key, "left").filter(F.col("turn_index") > F.coalesce("up_to_turn", F.lit(0)))
    rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("turn_index")))).filter(F.col("__r") <= n)
    fields = [c for c in turns.columns if c not in (key, "turn_index")]
    recent = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn_index", *fields))).alias("turns"))
    return newest.select(key, "summary").join(recent, key, "full")


def recent_messages(rows: DataFrame, n: int = 20, key: str = "session_id", order: str = "ts") -> DataFrame:
    """The last ``n`` rows of each session."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__r") <= n).drop("__r")


def durable_field(response: Column, mode: Column) -> Column:
    """What later turns should see of a JSON response saved under a mode."""
    found = F.from_json(response, "map<string,string>")
    of = lambda name: F.nullif(F.trim(found[name]), F.lit(""))
    pair = F.when(of("character_principle").isNotNull() | of("applied_insight").isNotNull(), F.concat(F.coalesce(of("character_principle"), F.lit("")), F.lit(" / "), F.coalesce(of("applied_insight"), F.lit(""))))
    own = F.when(mode == "guided_learning", of("explanation")).when(mode == "open_analysis", of("analysis")).when(mode == "perspective_shift", F.coalesce(of("character_response"), pair))
    return F.coalesce(own, *[of(f) for f in DURABLE_FIELDS], F.substring(response, 1, 400))


def format_history(history: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``(conversation_id, history)`` as lines; turns hold turn_index, user_message, agent_response and mode."""

    def lines(t: Column) -> Column:
        said = durable_field(t.agent_response, t.mode)
        return F.array_compact(F.array(F.concat(F.lit("["), t.turn_index.cast("string"), F.lit("] User: "), t.user_message), F.when(said != "", F.concat(F.lit("     Tutor: "), said))))

    first = F.when(F.coalesce("summary", F.lit("")) != "", F.array(F.concat(F.lit("Earlier in conversation: "), F.col("summary")))).otherwise(F.array().cast("array<string>"))
    every = F.concat(first, F.flatten(F.transform(F.coalesce("turns", F.array().cast(history.schema["turns"].dataType)), lines)))
    return history.select(key, F.array_join(every, "\n").alias("history"))


def compaction_plan(turns: DataFrame, summaries: DataFrame, threshold: int = THRESHOLD, keep: int = KEEP_RECENT, key: str = "conversation_id") -> DataFrame:
    """``(conversation_id, from_turn, up_to_turn)`` of the conversations to compact; both ends are folded."""
    newest = summaries.groupBy(key).agg(F.max("up_to_turn").alias("prior"))
    rows = turns.groupBy(key).agg(F.count("*").alias("n"), F.max("turn_index").alias("last")).filter(F.col("n") > threshold)
    rows = rows.join(newest, key, "left").select(key, (F.coalesce("prior", F.lit(0)) + 1).alias("from_turn"), (F.col("last") - keep).alias("up_to_turn"))
    return rows.filter("up_to_turn >= from_turn")


def folded(turns: DataFrame, plan: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The turns that a plan folds."""
    return turns.join(plan, key).filter(F.col("turn_index").between(F.col("from_turn"), F.col("up_to_turn")))


def dominant_mode(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The most frequent mode; ties go to the one seen first."""
    counts = rows.groupBy(key, "mode").agg(F.count("*").alias("n"), F.min("turn_index").alias("first"))
    return counts.groupBy(key).agg(F.max_by("mode", F.struct(F.col("n"), -F.col("first"))).alias("mode"))


def dialogue(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The folded turns as text."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "user_message", "said"))), lambda t: F.concat(F.lit("User: "), t.user_message, F.lit("\nTutor: "), t.said))
    return rows.withColumn("said", durable_field(F.col("agent_response"), F.col("mode"))).groupBy(key).agg(F.array_join(lines, "\n").alias("dialogue"))


def accept_summary(rows: DataFrame, least: int = 20, most: int = 300) -> DataFrame:
    """Summaries of a fitting number of words."""
    return rows.filter(T.token_count(F.col("summary")).between(least, most))


def conversation_cost(ids: DataFrame, turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Turns, tokens and cost of each named conversation; zeros for an unknown one."""
    sums = turns.groupBy(key).agg(F.count("*").alias("turns"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"))
    return ids.select(key).distinct().join(sums, key, "left").fillna(0, ["turns", "tokens_in", "tokens_out", "cost_usd"])


def turn_costs(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Cost of each turn and up to it."""
    return turns.select(key, "turn_index", "cost_usd", F.sum("cost_usd").over(W.partitionBy(key).orderBy("turn_index")).alias("cumulative_usd"))


def prior_turn(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``prior_mode`` and ``prior_character`` of the turn before."""
    w = W.partitionBy(key).orderBy("turn_index")
    return turns.withColumn("prior_mode", F.lag("mode").over(w)).withColumn("prior_character", F.lag("character").over(w))


def _bound(character: Column) -> Column:
    return ~F.trim(F.coalesce(character, F.lit(""))).isin("", DEFAULT_CHARACTER)


def decide_mode(routed: Column, confidence: Column, prior: Column, character: Column) -> Column:
    """(mode, source) of a turn from the router's word and the turn before: six rules, the first that fits."""
    made = lambda mode, source: F.struct(mode.alias("mode"), F.lit(source).alias("source"))
    real = routed.isNotNull() & (routed != "none")
    return (
        F.when(prior.isNull() | (prior == "none"), made(routed, "router"))
        .when(routed.eqNullSafe(prior), made(prior, "router"))
        .when((prior == "perspective_shift") & _bound(character) & real, made(prior, "character-lock"))
        .when((confidence == "high") & real, made(routed, "router-override"))
        .otherwise(made(prior, "sticky"))
    )


def effective_mode(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``(conversation_id, turn_index, mode, source)`` where each turn's prior is the mode decided before it.

    ``turns(…, routed_mode, confidence, character)``; an ordered fold over a conversation.
    """
    item = F.struct("turn_index", "routed_mode", "confidence", "character")
    packed = turns.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("ts"))
    start = F.struct(F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("character"), F.array().cast("array<struct<turn_index:bigint,mode:string,source:string>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        made = decide_mode(t.routed_mode, t.confidence, acc.mode, acc.character)
        row = F.struct(t.turn_index.cast("bigint").alias("turn_index"), made["mode"].alias("mode"), made["source"].alias("source"))
        return F.struct(made["mode"].alias("mode"), t.character.alias("character"), F.concat(acc.out, F.array(row)).alias("out"))

    return packed.select(key, F.explode(F.aggregate("ts", start, step, lambda a: a.out)).alias("x")).select(key, "x.turn_index", "x.mode", "x.source")


def resolve_character(source: Column, prior_character: Column, detected: Column) -> Column:
    """(character, how): inherited on a sticky turn, else detected in the text, else to be asked for."""
    made = lambda c, how: F.struct(c.alias("character"), F.lit(how).alias("how"))
    return F.when(source.isin("sticky", "character-lock") & _bound(prior_character), made(prior_character, "inherited")).when(detected.isNotNull(), made(detected, "detected")).otherwise(made(F.lit(None).cast("string"), "ask"))


def input_ok(text: Column, conversation_id: Column) -> Column:
    """ok, short or terse."""
    said = F.trim(text)
    return F.when(F.length(said) < 3, "short").when(F.lower(said).isin(*TERSE_WORDS) & conversation_id.isNull(), "terse").otherwise("ok")


def parse_router(mode: Column, kwargs: Column, confidence: Column) -> Column:
    """(mode, kwargs, confidence) with unknown values replaced: none, {} and low."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(mode, F.lit("")))), "[ -]", "_")
    body = F.trim(F.coalesce(kwargs, F.lit("")))
    sure = F.lower(F.trim(F.coalesce(confidence, F.lit(""))))
    return F.struct(
        F.when(name.isin(*MODES), name).otherwise(F.lit("none")).alias("mode"),
        F.when(F.startswith(body, F.lit("{")) & F.json_object_keys(body).isNotNull(), body).otherwise(F.lit("{}")).alias("kwargs"),
        F.when(sure.isin("low", "medium", "high"), sure).otherwise(F.lit("low")).alias("confidence"),
    )


def compaction_curve(turns: DataFrame, thresholds: list[int], keep: int = KEEP_RECENT, summary_chars: int = 400, key: str = "conversation_id") -> DataFrame:
    """``(conversation_id, threshold, turn_index, chars, verbatim, has_summary)`` after each turn of a log with ``chars``.

    Once a conversation is longer than the threshold every turn compacts it to its last ``keep`` turns.
    """
    w = W.partitionBy(key).orderBy("turn_index")
    total = F.sum("chars").over(w)
    recent = F.sum("chars").over(w.rowsBetween(-(keep - 1), 0))
    base = turns.select(key, "turn_index", F.row_number().over(w).alias("n"), total.alias("total"), recent.alias("recent"))
    rows = base.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    over = F.col("n") > F.col("threshold")
    return rows.select(key, "threshold", "turn_index", "n", F.when(over, F.col("recent") + summary_chars).otherwise(F.col("total")).alias("chars"), F.when(over, F.least(F.col("n"), F.lit(keep))).otherwise(F.col("n")).alias("verbatim"), over.alias("has_summary"))


def curve_summary(curve: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Most, median, least and last characters, and compactions."""
    return curve.groupBy(key, "threshold").agg(F.max("chars").alias("max_chars"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY chars)").alias("median_chars"), F.min("chars").alias("min_chars"), F.max_by("chars", "turn_index").alias("final_chars"), F.count_if(F.col("has_summary")).alias("compactions"))


def is_bounded(curve: DataFrame, slack: float = 1.3, key: str = "conversation_id") -> DataFrame:
    """Whether the size after the first compaction never exceeds ``slack`` times its value there."""
    after = curve.filter("has_summary")
    return after.groupBy(key, "threshold").agg((F.max("chars") <= slack * F.min_by("chars", "turn_index")).alias("bounded"))


def stored_fields(response: Column) -> Column:
    """A JSON object's values that are not null."""
    return F.map_filter(F.from_json(response, "map<string,string>"), lambda k, v: v.isNotNull())


def render_answer(response: Column, mode: Column) -> Column:
    """A structured answer as text, by mode."""
    found = F.from_json(response, "map<string,string>")
    of = lambda name: F.coalesce(found[name], F.lit(""))
    graded = F.concat(F.when(of("is_passing") == "true", F.lit("PASS")).otherwise(F.lit("FAIL")), F.lit(" ("), of("score"), F.lit("): "), of("critique"))
    debated = F.concat(F.lit("For: "), of("arguments_for"), F.lit("\nAgainst: "), of("arguments_against"), F.lit("\nVerdict: "), of("verdict"))
    return F.when(mode == "exam_grader", graded).when(mode == "debate", debated).when(mode == "satirical_podcast", of("transcript")).otherwise(durable_field(response, mode))
