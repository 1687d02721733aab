"""Line dedup: against a plain count, its runs, and odd tables."""

import hashlib
import random
import string
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import line_dedup as L

LONG = "This line is repeated in many of the documents."


def plain(rows):
    """(doc_id, n_lines, n_dropped, digest) of each row, by the definition."""
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc_id)
    gone = {k: max(x for x in ids if x is not None) for k, ids in held.items() if len(k) >= 40 and len(ids) >= 5}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = L.dedup_lines(df, **kw).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    return sorted(map(tuple, out.collect()), key=str)


def corpus():
    rng = random.Random(5)
    pool = [f"{'x' * rng.randrange(20, 60)} line number {i} Ä" for i in range(40)]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 9))]
        lines = [rng.choice((x, x.upper().replace("Ä", "Ä"), f" \t{x}\r", x)) for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_the_plain_count_for_any_number_of_batches(spark):
    rows = corpus()
    want = plain(rows)
    assert any(x[2] for x in want)
    for batches in (1, 5):
        assert found(spark, rows, batches=batches) == want


def test_nulls_repeats_ties_and_long_texts(spark):
    rows = [(None, LONG), (None, LONG), (1, LONG), (2, f"{LONG}\n{LONG.lower()}  \nother"), (3, f"\t{LONG}"), (3, "unlike"), (4, LONG), (4, LONG)]
    rows += [(5, None), (6, ""), (7, "\n\n"), (8, "y" * 300_000), (9, "a\n" * 50_000)]
    got = found(spark, rows, batches=3)
    assert got == plain(rows)
    assert sum(x[2] for x in got) == 6  # all but those of document 4, held by five documents
    # One document less, and nothing goes.
    assert sum(x[2] for x in found(spark, [r for r in rows if r[0] is not None], batches=2)) == 0


def test_key_length_is_that_without_blanks(spark):
    short = "z" * 39
    rows = [(i, f"{short}   \t") for i in range(6)] + [(i, "é" * 40) for i in range(10, 16)]
    assert found(spark, rows) == plain(rows)
    assert sum(x[2] for x in found(spark, rows)) == 5


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([(i, LONG, 3, "q") for i in range(6)], "doc_id long, text string, N_LINES int, h1 string")
    out = L.dedup_lines(df.withColumn("pos", F.lit(1)).withColumn("batch", F.lit("b")))
    assert out.count() == 6 and "h1" in out.columns and out.columns.count("n_lines") == 1
    assert out.agg(F.sum("n_dropped")).first()[0] == 5


def test_runs_are_levelled_sorted_and_exact_in_any_order(spark):
    rows = [(i, "\n".join(f"{LONG} {j}" for j in range(10) if i % (j + 1) == 0)) for i in range(60)]
    lines = L.keyed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {(r.h1, r.h2): r.keeper for r in L.counted(lines).filter("n >= 5").collect()}
    for order in (range(9), reversed(range(9))):
        runs = L.LineRuns(spark, buckets=4, fan_in=3)
        sizes = []
        for i in order:
            runs.add(lines.filter(F.col("doc_id") % 9 == i))
            sizes.append([len(level) for level in runs.levels])
        assert sizes[2] == [0, 1] and sizes[-1] == [0, 0, 1]
        assert {(r.h1, r.h2): r.keeper for r in runs.frequent().collect()} == want
        table = spark.table(runs.names()[0])
        assert table.count() == table.select("h1", "h2").distinct().count()
        runs.close()
        assert runs.names() == []


def test_settled_keys_are_not_added_again(spark):
    lines = L.keyed_lines(spark.createDataFrame([(i, LONG) for i in range(20)], "doc_id long, text string"))
    runs = L.LineRuns(spark, buckets=2)
    runs.add(lines.filter("doc_id >= 10"))
    runs.add(lines.filter("doc_id < 10"))
    assert [spark.table(n).count() for n in runs.names()] == [1, 0]
    plan = spark.table(runs.names()[0]).alias("a").join(spark.table(runs.names()[1]).alias("b").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs meet bucket by bucket
    runs.close()
