import pytest

from tessera.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_phrases(text, sample):
    """Greedy longest phrases of text that occur in sample; an unseen character is a phrase of its own."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_phrases_match_brute_force():
    samples = {"xx": ["the cat sat on the mat", "a rat"], "yy": ["der hund und die katze"]}
    model = langid.build(samples)
    texts = ["the mat und die rat", "zzz", "", "THE CAT", "der hund"]
    import numpy as np

    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    got = langid._phrases(model, *langid.coded(model.symbol, points, np.array([len(t) for t in texts])))
    for t, row in zip(texts, got.tolist()):
        assert row == [plain_phrases(t.lower(), "\x01".join(samples[k])) for k in ("xx", "yy")]


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "the cat sat on the mat " * 20, "en", 1), (2, "der hund und die katze " * 20, "de", 2), (3, None, None, 3), (4, "123 !?", None, 4), (None, "the the cat", None, 5)],
        "doc_id long, text string, lang string, lang_x int",
    )
    model = langid.train(docs)
    got = {r.lang_x: (r.lang_pred, r.lang_score) for r in langid.identify(docs, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "en"]
    assert got[3][1] == got[4][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    none = langid.train(docs.filter("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    model = langid.train(docs.filter(langid.training_rows()))
    out = langid.identify(docs, model).filter(~langid.training_rows())
    right, total = out.selectExpr("sum(int(lang_pred = lang)) r", "count(*) n").first()
    assert right / total == pytest.approx(1, abs=0.03)


def test_many_scripts_share_the_symbols():
    import random

    import numpy as np

    rng = random.Random(3)
    alphabets = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "zh": "".join(chr(0x4E00 + i) for i in range(900)), "ja": "".join(chr(0x3041 + i) for i in range(80)) + "".join(chr(0x4E00 + i) for i in range(300))}
    vocab = {k: ["".join(rng.choices(a, k=rng.randint(1, 6))) for _ in range(150)] for k, a in alphabets.items()}
    text = lambda k, n: " ".join(rng.choices(vocab[k], k=n))
    model = langid.build({k: [text(k, 800) for _ in range(3)] for k in alphabets})
    codes = model.symbol[model.symbol > 0]
    assert (codes > 0xFFFF).any() and {int(c) & 0xFF for c in codes} < set(range(1, langid.SYMBOLS - 1))
    for k in alphabets:
        assert langid.predict(model, [text(k, 12) for _ in range(40)])[0] == [k] * 40
    # Each character of a sample is a way back to itself, and a text of two is the symbols of both.
    line = "".join(alphabets.values())
    points = np.array([ord(c) for c in line], np.uint32)
    symbols, lengths = langid.coded(model.symbol, points, np.array([10, 0, len(line) - 10]))
    assert len(symbols) == lengths.sum() and lengths[1] == 0
    packed = {tuple(langid.coded(model.symbol, points[i : i + 1], np.array([1]))[0].tolist()): 0 for i in range(len(points))}
    assert len(packed) == len({c for c in line if model.symbol[ord(c)]}) + any(not model.symbol[ord(c)] for c in line)


def test_repeated_rows_do_not_fill_the_sample(spark):
    docs = spark.range(20000).selectExpr("7L doc_id", "'the same text again' text", "'en' lang").unionAll(spark.createDataFrame([(i, f"other {i}", "en") for i in range(50)], "doc_id long, text string, lang string"))
    assert langid.train(docs).langs == ["en"]


def test_recognised_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "a", 0.5, "b"), (2, None, "en", "a", 0.5, "b")], "doc_id long, text string, lang string, lang_pred string, LANG_SCORE double, text_ string")
    out = langid.recognised(docs, langid.train(docs))
    assert out.collect() == docs.filter("doc_id = 1").collect() and out.columns == docs.columns
    assert langid.identify(docs, langid.train(docs)).columns == ["doc_id", "text", "lang", "text_", "lang_pred", "lang_score"]
