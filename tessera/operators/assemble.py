"""Context assembly and token budgets."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.rank import dedup_jaccard
from tessera.operators.retrieve import min_score

PREAMBLE = "Relevant knowledge:"


def _strip(c: Column) -> Column:
    return T.strip(c)


def format_naive(items: Column, preamble: str = PREAMBLE) -> Column:
    """Preamble and texts in the given order."""
    return _strip(F.concat(F.lit(preamble + "\n\n"), F.array_join(F.transform(items, lambda s: s.text), "\n\n")))


def format_relevance(items: Column, preamble: str = PREAMBLE) -> Column:
    """Numbered texts with their scores."""
    line = lambda s, i: F.format_string("[%d] (score=%.2f) %s", i + 1, s.score, s.text)
    return _strip(F.concat(F.lit(preamble + "\n\n"), F.array_join(F.transform(items, line), "\n\n")))


def format_sandwich(items: Column, preamble: str = PREAMBLE) -> Column:
    """The best text first and once more at the end."""
    best = F.get(items, F.lit(0)).text
    rest = F.transform(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), lambda s: s.text)
    parts = F.concat(F.array(F.concat(F.lit("[Key passage] "), best)), rest, F.array(F.concat(F.lit("[Key passage – repeated for emphasis] "), best)))
    return _strip(F.concat(F.lit(preamble + "\n\n"), F.array_join(parts, "\n\n")))


def format_citation(items: Column, preamble: str = PREAMBLE) -> Column:
    """Numbered texts and a line of sources."""
    texts = F.transform(items, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s.text))
    label = lambda s: F.concat(F.coalesce(s.doc_id.cast("string"), F.lit("unknown")), F.when(F.coalesce(s.chapter, F.lit("")) != "", F.concat(F.lit(", "), s.chapter)).otherwise(F.lit("")))
    refs = F.transform(items, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), label(s)))
    return _strip(F.concat(F.lit(preamble + "\n\n"), F.array_join(texts, "\n\n"), F.lit("\n\nSources: "), F.array_join(refs, " | ")))


FORMATS = {"naive": format_naive, "relevance": format_relevance, "sandwich": format_sandwich, "citation": format_citation}


def assemble(rows: DataFrame, strategy: str = "sandwich", least: float = 0.0, most: int = 10, threshold: float = 0.95, preamble: str = PREAMBLE, queries: DataFrame | None = None) -> DataFrame:
    """``(query_id, context)`` from ``rows(query_id, rank, doc_id, chapter, text, score)``.

    Scores below ``least`` go, then rows after the first ``most``, then near-duplicates; then rows are ordered and
    formatted. Queries without a row have an empty context, if ``queries`` names them.
    """
    kept = min_score(rows, least)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= most)
    kept = dedup_jaccard(kept.select("query_id", "rank", "doc_id", "chapter", "text", "score"), threshold)
    by_score = strategy in ("relevance", "sandwich")
    first = (-F.col("score")).alias("o") if by_score else F.lit(0.0).alias("o")
    items = F.array_sort(F.collect_list(F.struct(first, "rank", "doc_id", "chapter", "text", "score")))
    out = kept.groupBy("query_id").agg(items.alias("items")).select("query_id", FORMATS[strategy](F.col("items"), preamble).alias("context"))
    return out if queries is None else queries.select("query_id").distinct().join(out, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def as_messages(contexts: DataFrame) -> DataFrame:
    """One message for each context that is not empty."""
    return contexts.filter("context <> ''").select("query_id", F.struct(F.lit("retrieval").alias("role"), F.col("context").alias("content")).alias("message"))


def with_tokens(rows: DataFrame, text: str = "content") -> DataFrame:
    """``tokens``: whitespace words of a text."""
    return rows.withColumn("tokens", T.token_count(F.col(text)))


def budget(rows: DataFrame, most: int, reserved: int = 0, key: str = "session_id") -> DataFrame:
    """Used and remaining tokens."""
    return rows.groupBy(key).agg(F.sum("tokens").alias("used")).withColumn("remaining", F.lit(most - reserved) - F.col("used"))


def fit_budget(rows: DataFrame, most: int, key: str = "session_id", order: str = "ts", compress: Callable[[list[str]], str] | None = None, protected: tuple[str, ...] = ("system",)) -> DataFrame:
    """The entries ``(session_id, role, content, tokens, priority, ts)`` that a session holds at its end, with ``error`` for those refused.

    Entries come in order. To make room the lowest by (priority, ts) go, never ``protected`` roles. If nothing more can
    go, ``compress`` makes one entry of priority 2 of all retrieved ones; an entry over the budget is refused, as is one
    for which there is no room even then. A session is the bounded group of the fold, which keeps a heap and running sums.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held, refused = {}, []  # entries by their number in order of arrival
        free: list[tuple] = []  # a heap of those that may go: the lowest (priority, time) first, then the earliest
        retrieved: dict[int, dict] = {}  # those held of the retrieval role
        fresh = used = 0  # retrieved entries that are no summary; tokens held

        def add(number: int, row: dict) -> None:
            nonlocal fresh, used
            held[number], used = row, used + row["tokens"]
            if row["role"] not in protected:
                heapq.heappush(free, (row["priority"], row[order], number))
            if row["role"] == "retrieval":
                retrieved[number], fresh = row, fresh + (row["priority"] != 2.0)

        def drop(number: int) -> None:
            nonlocal fresh, used
            row = held.pop(number)
            used -= row["tokens"]
            if retrieved.pop(number, None) is not None:
                fresh -= row["priority"] != 2.0

        number = 0
        for row in frame.sort_values(order, kind="stable").to_dict("records"):
            if row["tokens"] > most:
                refused.append(row | {"error": "entry exceeds budget"})
                continue
            while used + row["tokens"] > most:
                if free:
                    drop(heapq.heappop(free)[2])
                elif compress is not None and fresh:
                    found = list(retrieved.values())
                    said = compress([h["content"] for h in found])
                    for n in list(retrieved):
                        drop(n)
                    number += 1
                    add(number, found[-1] | {"content": said, "tokens": len(said.split()), "priority": 2.0})
                else:
                    refused.append(row | {"error": "budget exhausted"})
                    break
            else:
                number += 1
                add(number, row | {"error": None})
        return pd.DataFrame([*held.values(), *refused], columns=[*frame.columns, "error"])

    return rows.groupBy(key).applyInPandas(run, rows.withColumn("error", F.lit(None).cast("string")).schema)


def clear_retrieval(rows: DataFrame) -> DataFrame:
    """Rows without those of the retrieval role."""
    return rows.filter(F.col("role") != "retrieval")


def snapshot(rows: DataFrame, most: int, key: str = "session_id", order: str = "ts", cut: int = 80) -> DataFrame:
    """Budget, used, remaining, entries and previews."""
    out = rows.groupBy(key).agg(F.sum("tokens").alias("used"), F.count("*").alias("entries"), F.transform(F.array_sort(F.collect_list(F.struct(order, "role", "content"))), lambda s: F.concat(s.role, F.lit(": "), F.substring(s.content, 1, cut))).alias("previews"))
    return out.withColumn("budget", F.lit(most)).withColumn("remaining", F.lit(most) - F.col("used"))


def split_budget(total: int, ratio: float = 0.6) -> tuple[int, int]:
    """Tokens for recent rows and for the summary."""
    recent = int(total * ratio)
    return recent, total - recent


def over_budget(rows: DataFrame, recent: int, key: str = "session_id", order: str = "ts") -> DataFrame:
    """The oldest rows whose going brings the rest within the budget."""
    before = F.coalesce(F.sum("tokens").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("tokens").over(W.partitionBy(key))
    return rows.withColumn("__left", total - before).filter(F.col("__left") > recent).drop("__left")


def apply_summary(rows: DataFrame, covered: DataFrame, summaries: DataFrame, key: str = "session_id", order: str = "ts") -> DataFrame:
    """``rows`` without covered ones, and one summary row ``(session_id, content)`` of priority 10 in front."""
    left = rows.join(covered.select(key, order), [key, order], "left_anti")
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    new = summaries.join(first, key).select(key, F.lit("system").alias("role"), "content", T.token_count(F.col("content")).alias("tokens"), F.lit(10.0).alias("priority"), (F.col("__first") - 1).alias(order))
    return left.select(*new.columns).unionByName(new)


def covered_hash(rows: DataFrame, key: str = "session_id", order: str = "ts") -> DataFrame:
    """Hash of a session's contents in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda s: s.content)
    return rows.groupBy(key).agg(F.sha2(F.array_join(texts, ""), 256).alias("covered_hash"))


def latest_summary(summaries: DataFrame, key: str = "session_id", at: str = "created_at") -> DataFrame:
    """The newest summary of each session."""
    return summaries.groupBy(key).agg(F.max_by("summary_text", at).alias("summary_text"))


def stub_summary(rows: DataFrame, key: str = "session_id", order: str = "ts", cut: int = 80) -> DataFrame:
    """A summary without a model: beginnings joined by bars."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda s: F.substring(s.content, 1, cut))
    return rows.groupBy(key).agg(F.concat(F.lit("Summary: "), F.array_join(texts, " | ")).alias("summary"))


def slots(template: str) -> list[str]:
    """Names of a template's ``{{SLOTS}}``."""
    return sorted(set(re.findall(r"\{\{(\w+)\}\}", template)))


def render(template: str, values: dict[str, Column], defaults: dict[str, str] | None = None) -> Column:
    """A template with its slots filled; raises if one has neither value nor default."""
    missing = [s for s in slots(template) if s not in values and s not in (defaults or {})]
    if missing:
        raise ValueError(f"missing slots: {', '.join(missing)}")
    parts = [F.coalesce(values[p], F.lit("")) if i % 2 and p in values else F.lit((defaults or {})[p] if i % 2 else p) for i, p in enumerate(re.split(r"\{\{(\w+)\}\}", template))]
    return F.concat(*parts)


def inject_context(context: Column) -> Column:
    """Context between tags; an empty one stays empty."""
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("<context>\n"), context, F.lit("\n</context>")))


def to_messages(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """``(query_id, position, role, content)`` from ``summary, history (array of role and content), profile, retrieval, message``; empty slots are left out."""
    tagged = lambda c, name: F.struct(F.lit("system").alias("role"), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"[{name}]\n"), F.col(c))).otherwise(F.lit("")).alias("content"))
    every = F.flatten(F.array(F.array(tagged("summary", "Conversation summary")), F.col("history"), F.array(tagged("profile", "User profile")), F.array(tagged("retrieval", "Retrieved passages")), F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("content")))))
    return rows.select(key, F.posexplode(F.filter(every, lambda m: m.content != "")).alias("position", "m")).select(key, "position", "m.role", "m.content")


def token_estimate(*slots_: Column) -> Column:
    """Whitespace words over all slots."""
    return T.token_count(F.concat_ws(" ", *slots_))


def stub_answer(messages: DataFrame, key: str = "query_id") -> DataFrame:
    """An answer without a model: the retrieval messages, or a sentence that there are none."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "retrieval", F.struct("position", "content")))), lambda s: s.content)
    return messages.groupBy(key).agg(texts.alias("t")).select(key, F.when(F.size("t") == 0, F.lit("No context available.")).otherwise(F.array_join("t", "\n")).alias("answer"))
