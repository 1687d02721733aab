"""Text screening by ordered rules, argument contracts, tags and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import join_checked

#: Rules on prompts (pattern, level, reason), in order.
PROMPT_RULES = (
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?", "block", "Role override: 'ignore previous instructions'"),
    (r"disregard\s+(all\s+)?(previous|prior)\s+instructions?", "block", "Role override: 'disregard instructions'"),
    (r"you\s+are\s+now\s+(a|an|the)\s+\w+", "warn", "Persona override: 'you are now ...'"),
    (r"(repeat|print|output|reveal|show|tell me)\s+(your|the)\s+(system\s+)?prompt", "block", "Prompt extraction attempt"),
    (r"what\s+(are|were)\s+your\s+(original\s+)?instructions", "block", "Instruction extraction attempt"),
    (r"\b(DAN|STAN|jailbreak|developer\s+mode|god\s+mode)\b", "block", "Known jailbreak keyword"),
    (r"```\s*(system|assistant|human|user)\s*\n", "warn", "Context escape via code block"),
    (r"<\s*/?(system|assistant|human|user)\s*>", "warn", "Context escape via XML-like tag"),
    (r"if\s+you\s+(are|were)\s+asked.{0,60}(do not|don't|never)", "warn", "Conditional instruction injection"),
)
#: Rules on outputs (pattern, reason), in order.
OUTPUT_RULES = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "SSN pattern detected in output"),
    (r"\b(?:\d[ -]?){13,16}\b", "Credit card number pattern detected"),
    (r"(api[_-]?key|secret|password|token)\s*[:=]\s*\S+", "Credential pattern in output"),
    (r"(my system prompt|my instructions are|i was told to)", "Potential system prompt leak"),
    (r"\b(make\s+a\s+bomb|synthesize\s+\w+\s+drug)\b", "Harmful content policy violation"),
)
#: What stands in place of a blocked answer; messages of input checks.
SAFE_TEXT = "I'm unable to provide that response due to a content policy restriction."
TOO_SHORT, TOO_LONG, DISALLOWED, PATTERN = "Input too short (min %d)", "Input too long (max %d chars)", "Input contains disallowed characters", "Blocked pattern matched: "
#: What makes a turn escalate.
ESCALATION_PHRASES = ("speak to a human", "talk to someone", "real person", "not helpful", "wrong answer")
ESCALATION_ERRORS = ("AuthenticationError", "RateLimitError", "PermissionError")
QUESTION_SIGNALS = ("who", "what", "where", "when", "why", "how", "tell me")


def _verdict(level: Column, reason: Column, matched: Column) -> Column:
    return F.struct(level.alias("level"), reason.alias("reason"), matched.alias("matched"))


def _safe() -> Column:
    return _verdict(F.lit("safe"), F.lit(""), F.lit(""))


def prompt_guard(text: Column, rules=PROMPT_RULES) -> Column:
    """(level, reason, matched): the first rule that blocks, else the last that warns, else safe."""
    hit = lambda p: F.regexp_extract(text, f"(?is){p}", 0)
    blocked = [F.when(F.rlike(text, F.lit(f"(?is){p}")), _verdict(F.lit("block"), F.lit(r), hit(p))) for p, level, r in rules if level == "block"]
    warned = [F.when(F.rlike(text, F.lit(f"(?is){p}")), _verdict(F.lit("warn"), F.lit(r), hit(p))) for p, level, r in reversed(rules) if level == "warn"]
    return F.coalesce(*blocked, *warned, _safe())


def validate_input(text: Column, least: int = 1, most: int = 4096, allowed: str | None = None, blocked: tuple[str, ...] = ()) -> Column:
    """(level, reason, matched) by length, allowed characters and blocked patterns."""
    block = lambda reason: _verdict(F.lit("block"), reason, F.lit(""))
    checks = [F.when(F.length(text) < least, block(F.lit(TOO_SHORT % least))), F.when(F.length(text) > most, block(F.lit(TOO_LONG % most)))]
    if allowed:
        checks.append(F.when(~F.rlike(text, F.lit(rf"(?s)\A[{allowed}]+\z")), block(F.lit(DISALLOWED))))
    for p in blocked:
        checks.append(F.when(F.rlike(text, F.lit(f"(?i){p}")), block(F.concat(F.lit(PATTERN), F.regexp_extract(text, f"(?i){p}", 0)))))
    return F.coalesce(*checks, _safe())


def output_filter(text: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """(level, reason, matched) of the first rule that matches."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(f"(?i){p}")), _verdict(F.lit("block"), F.lit(r), F.lit(""))) for p, r in (*OUTPUT_RULES, *extra)], _safe())


def safe_text(text: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """The text, or a fixed message in place of a blocked one."""
    return F.when(output_filter(text, extra)["level"] == "block", F.lit(SAFE_TEXT)).otherwise(text)


def screen_input(text: Column, **limits) -> Column:
    """The validation's verdict if it blocks, else the guard's."""
    valid = validate_input(text, **limits)
    return F.when(valid["level"] == "block", valid).otherwise(prompt_guard(text))


def audit_calls(calls: DataFrame, rules: DataFrame, default_allow: bool = False) -> DataFrame:
    """``calls(capability, tool, ...)`` with ``allowed`` by ``rules(capability, tools)``, a row a capability."""
    ok = F.when(F.col("tools").isNull(), F.lit(default_allow)).otherwise(F.array_contains("tools", F.col("tool")))
    return join_checked(calls, rules.select("capability", "tools"), "capability", "left").withColumn("allowed", ok).drop("tools")


def should_escalate(message: Column, context: Column, error: Column) -> Column:
    """Whether an error type, a phrase, or a question without context calls for a human."""
    low = F.lower(message)
    has = lambda phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))
    listed = F.coalesce(error.isin(*ESCALATION_ERRORS), F.lit(False))
    return listed | has(ESCALATION_PHRASES) | ((F.trim(F.coalesce(context, F.lit(""))) == "") & has(QUESTION_SIGNALS))


def check_contract(arguments: Column, contract: dict[str, dict]) -> Column:
    """The first violation of a contract by a map of arguments, else null.

    A parameter has ``type`` (string, integer, number, boolean), ``required``, ``enum``, ``min``, ``max`` and ``pattern``.
    """
    shapes = {"integer": r"[+-]?\d+", "number": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", "boolean": "true|false"}
    checks = [F.when(~F.map_contains_key(arguments, name) , F.lit(f"missing required: {name}")) for name, p in contract.items() if p.get("required")]
    unknown = F.array_except(F.map_keys(arguments), F.array(*[F.lit(n) for n in contract]))
    checks.append(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.get(F.sort_array(unknown), F.lit(0)))))
    for name, p in contract.items():
        value = arguments[name]
        if p.get("type") in shapes:
            checks.append(F.when(~F.rlike(value, F.lit(f"^({shapes[p['type']]})$")), F.lit(f"wrong type: {name}")))
        if p.get("enum"):
            checks.append(F.when(~value.isin(*p["enum"]), F.lit(f"not allowed: {name}")))
        if "min" in p:
            checks.append(F.when(value.try_cast("double") < p["min"], F.lit(f"below minimum: {name}")))
        if "max" in p:
            checks.append(F.when(value.try_cast("double") > p["max"], F.lit(f"above maximum: {name}")))
        if p.get("pattern"):
            checks.append(F.when(~F.rlike(value, F.lit(f"^({p['pattern']})$")), F.lit(f"no match: {name}")))
    return F.coalesce(*checks)


def clean_tags(tags: Column, vocabulary: list[str]) -> Column:
    """Trimmed lower-case tags with hyphens that are in the vocabulary, once each, in order."""
    known = F.array(*[F.lit(v) for v in vocabulary]).cast("array<string>")
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.replace(F.lower(F.trim(t)), F.lit("_"), F.lit("-"))), lambda t: F.array_contains(known, t)))


def tag_batches(rows: DataFrame, tag: Callable[[list[str]], dict[int, list[str]]], size: int = 10, cut: int = 1800) -> DataFrame:
    """``(chunk_id, themes, error)``: a tagger sees batches of ``size`` texts and answers by position; a batch with missing answers fails as a whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), size):
                batch = part.iloc[at : at + size]
                try:
                    found = tag([t[:cut] for t in batch["text"]])
                    answers, error = [list(found[i]) for i in range(len(batch))], None
                except Exception as problem:  # the hook's own failures become rows
                    answers, error = [None] * len(batch), f"{type(problem).__name__}: {problem}"
                yield pd.DataFrame({"chunk_id": batch["chunk_id"].to_numpy(), "themes": answers, "error": [error] * len(batch)})

    return rows.select("chunk_id", "text").mapInPandas(run, "chunk_id string, themes array<string>, error string")


def stratified_sample(rows: DataFrame, key: str, k: int, id_col: str, seed: int = 0) -> DataFrame:
    """``k`` rows of each key, drawn by hash of id and seed."""
    draw = F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))), 256)
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(draw, id_col))).filter(F.col("__n") <= k).drop("__n")


def review_rows(rows: DataFrame, cut: int = 200) -> DataFrame:
    """One line of text for each tagged chunk."""
    return rows.select("chunk_id", F.format_string("[ ] %s | %s | %s", F.col("chunk_id"), F.array_join("themes", ", "), F.substring("text", 1, cut)).alias("line"))
