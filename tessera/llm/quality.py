"""Quality rules, with DataFrame functions only: repetition within a text, and lines that many documents share.

The rules on one text are worked out in its row. Across documents, lines are normalised and hashed, distinct
documents are counted for each line and host, lines above a limit are taken out, and a document of which too
little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

WINDOW = 5
#: A line goes if more than LINE_DOCS documents of its host hold it, however large the host is.
LINE_DOCS = 20
#: A document needs so many words after that, and so great a share of its words.
LEFT_WORDS, LEFT_SHARE = 10, 0.3
#: The rules on one text: least words, and the greatest percentage of repeated words.
MIN_WORDS, REPEAT_PERCENT = 10, 20

_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null for null."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text; windows are told by their hashes."""

    def spans(at: Column) -> Column:
        # Sorted starts cover the lesser of the window and the way to the next start.
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end")),
            lambda acc, i: F.struct((acc.n + window - F.greatest(acc.end - i, F.lit(0))).alias("n"), (i + window).alias("end")),
            lambda acc: acc.n,
        )

    def twice(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        alike = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1).h == x.h) | (F.get(s, k + 1).h == x.h))
        return let(ordered, lambda s: spans(F.sort_array(F.transform(F.filter(alike(s), lambda x: x.h.isNotNull()), lambda x: x.i))))

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - window)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(twice(hashes))

    hashed = let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > window, let(windows(h), counted)))
    return F.coalesce(hashed, F.lit(0)).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def normalised(line: Column) -> Column:
    """A line in lower case, its digits as zeros, its white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), _SPACE, " "))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(doc_id, host, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines)``, row for row.

    lines holds a hash and a word count for each line with a word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "host", text.alias("text"), words(text).alias("found"), lines.alias("own"))
    return rows.select(
        "doc_id",
        "host",
        F.concat(F.hex(F.xxhash64("text")), F.hex(F.hash("text"))).alias("text_key"),
        F.size("found").cast("long").alias("n_words"),
        (F.length("text") - _without(F.col("text"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _without(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("found")).alias("n_repeat_words"),
        F.transform("own", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))).alias("lines"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_left)``, row for row.

    base_failed: fewer than MIN_WORDS words, or more than REPEAT_PERCENT percent of them repeated. n_left: words in
    lines that stay. kept: not base_failed, and n_left at least ``left_words`` and ``left_share`` of the words.
    Equal texts of one host count as one document when a line's documents are counted, so that copies do not
    turn their lines into boilerplate. A null text has no words and fails; a null host is a host of its own; a
    null id stays null; repeated rows come out as often as they go in. Counts for a line and host are summed
    before they are dealt out, and joins on a frequent line or text can be split.
    """
    rows = materialise(measures(docs, id_col, text_col, host_col), "measures")
    texts = rows.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    texts = materialise(texts, "texts")
    held = texts.select("host", "text_key", F.explode("lines").alias("line")).select("host", "text_key", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    counts = held.groupBy("host", "h", "text_key").agg(F.sum("n").alias("n"))
    often = counts.groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > line_docs)
    often = materialise(often.select(F.col("host").alias("host_"), F.col("h").alias("h_")), "lines")
    gone = counts.join(often, F.col("host").eqNullSafe(F.col("host_")) & (F.col("h") == F.col("h_")))
    gone = gone.groupBy("host", "text_key").agg(F.sum("n").alias("n_gone")).select(F.col("host").alias("host_"), F.col("text_key").alias("key_"), "n_gone")
    out = rows.drop("lines").join(gone, F.col("host").eqNullSafe(F.col("host_")) & (F.col("text_key") == F.col("key_")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("n_left", F.col("n_words") - F.coalesce("n_gone", F.lit(0))).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_left") >= left_words) & (F.col("n_left") >= left_share * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_left")


#: The same in SQL.
JUDGE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own
  FROM {docs}),
i AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
g AS (SELECT r, i, w[i:i+4] AS g FROM i),
t AS (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, g HAVING count(*) > 1),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM t),
q AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM p GROUP BY r),
l AS (SELECT r, host, text, unnest(own) AS line FROM d),
m AS (SELECT r, host, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS h,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
o AS (SELECT host, h, count(DISTINCT text) AS docs FROM m GROUP BY host, h),
f AS (SELECT host, h FROM o WHERE docs > 20),
x AS (SELECT m.r, sum(m.n)::BIGINT AS n_gone FROM m JOIN f ON m.host IS NOT DISTINCT FROM f.host AND m.h = f.h GROUP BY m.r),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(own) - len(list_distinct(own)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         (len(w) - coalesce(n_gone, 0))::BIGINT AS n_left
  FROM d LEFT JOIN q USING (r) LEFT JOIN x USING (r)),
k AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_left >= 10 AND n_left >= 0.3 * n_words) AS kept, n_left
FROM k
"""
