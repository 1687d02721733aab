"""Every stage and operator with nulls, empty texts, repeated rows, empty tables, and columns that have their own names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, html_text, langid, lm, mixing, pii, quality, secrets, simhash, tokens

SF_DIR = "/root/testdata/sf0.001"
CLASHING = (
    "spans BASE_SPANS masked_text lang_pred Lang_Score row_key key text_ found component fp id h size source_size target taken item_id k part range place w "
    "term text_key email ip card phone bits n_bytes n_tokens n_known logs tail held_out base_score score n_words kept n_left lines host words file ordinal block doc_text"
).split()
TEXT = "The old cat sat on the mat near the door and looked at the rain for most of the day without any wish to go out"


@pytest.fixture(scope="module")
def docs(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    rows = [
        (1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, TEXT, "en", "b"), (None, "Another text of some words that is here and says nothing", "en", None), (3, None, None, None),
        (4, "", "en", "a"), (5, " \n\t", None, "b"), (6, "!!! 123 ???", "en", "a"), (7, f"{TEXT[::-1]} {item} {TEXT[::-1]}", "en", "a"),
        (8, "password = 'abcdEFGH1234' is what I was told to use here, and no other one at all", "en", "b"), (None, None, "en", "a"), (9, "word " * 30_000, "en", "a"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("int"))
    return table.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).cache()


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))


@pytest.mark.parametrize("k", range(4))
def test_stages_return_their_columns(spark, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    want = {
        "language_id": [1, 1, 2, 4, 5, 7, 8, 9, None],
        "simhash_near_dedup": [1, 3, 6, 7, 8, 9, None],
        "benchmark_decontamination": [1, 1, 2, 3, 4, 5, 6, 8, 9, None, None],
        "secret_scan": [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, None],
    }[name]
    if name == "language_id":
        want = [x for x in want if x not in (4, 5)]  # no letter
    if name == "simhash_near_dedup":
        # Null, empty and blank texts are copies; the one with the least key stays, and a null id counts as negative.
        got = ids(rows)
        assert got[:1] == [1] and set(got) >= {6, 7, 8, 9} and len(got) == 7
        return
    assert ids(rows) == want
    by = {r.doc_id: r for r in rows}
    if name == "secret_scan":
        assert "abcdEFGH1234" not in by[8].text and by[8].n_chars == len(by[8].text) and by[3].text is None and by[4].text == ""


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, docs, k):
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF_DIR).count() == 0


def test_rows_of_one_id_with_unlike_texts_are_documents_of_their_own(spark):
    schema, other = "doc_id long, text string, n int", "Nothing that is said in this row is found in any of those above it or below it, in whatever order"
    kept = lambda rows: sorted((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, schema)).collect())
    assert kept([(5, TEXT, 0), (5, other, 1)]) == [(5, other), (5, TEXT)]
    assert kept([(1, TEXT, 0), (5, TEXT, 1), (5, other, 2)]) == [(1, TEXT), (5, other)]
    assert kept([(5, TEXT, 0), (5, TEXT, 1), (5, other, 2), (5, other, 3), (6, other, 4)]) == [(5, other), (5, TEXT)]
    assert len(kept([(None, TEXT, 0), (None, other, 1), (None, other, 2), (7, TEXT, 3)])) == 2


def test_mix_row_for_row(spark, docs):
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows) and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_operators_row_for_row(spark, docs):
    n = docs.count()
    model = langid.train(docs)
    found = [
        tokens.count_tokens(docs), simhash.near_duplicates(docs), quality.judge(docs), lm.score_documents(docs), secrets.find_secrets(docs, None), pii.find_pii(docs), pii.sanitise(docs),
        langid.identify(docs, model), html_text.extract_pages(docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "text")),
    ]
    assert [x.count() for x in found] == [n] * len(found)
    assert found[6].columns == docs.columns
    none = docs.limit(0)
    assert decontaminate.contaminated(none, docs.select("item_id", "text")).count() == decontaminate.contaminated(docs, none.select("item_id", "text")).count() == 0
    for empty in (tokens.count_tokens(none), simhash.near_duplicates(none), quality.judge(none), lm.score_documents(none), pii.find_pii(none), pii.sanitise(none), langid.identify(none, model)):
        assert empty.count() == 0


def test_ops_have_docstrings():
    from tessera.llm import queries

    assert all(run.__doc__ for run in queries.QUERIES.values()) and all(stage.__doc__ for _, stage in corpus_pipeline.STAGES)
