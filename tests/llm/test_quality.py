import random

import duckdb
import pandas as pd

from tessera.llm import quality


def rows():
    rng = random.Random(8)
    vocab = "a b c d e f g h".split()
    out = [(i, "\n".join(" ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 6))), "s") for i in range(80)]
    out += [(100 + i, f"{i} unlike the others in all of its words {i}\nShared  footer line {i}\n" + "x y z " * (i % 3), "t") for i in range(60)]
    out += [(300 + i, "only shared\nfooter of all here now to see\nand " + "zz " * (i % 30), "u") for i in range(60)]
    return [*out, (None, None, None), (7, "", None), (8, "# * $ é <b> | & %\x0b\x0c", "s"), out[0], out[0], (9, "w " * 4000, "s")]


def test_judge_matches_sql(spark):
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows()], "doc_id long, text string, source string, h int, host string")
    got = quality.judge(docs).toPandas()
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows(), columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = con.sql(quality.JUDGE_SQL.replace("{docs}", "frame")).df()
    names = list(got.columns)
    a, b = (x[names].fillna(-1).astype(int).sort_values(names).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)
    assert 0 < got.kept.sum() < len(got) and (got.n_left < got.n_words).any()


def test_repeated_words_by_hand(spark):
    texts = [("a b c d e x a b c d e", 10), ("a a a a a a a", 7), ("a b c d e f", 0), ("a b c d e a b c d e f", 10), (None, 0)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "text string")
    got = [r[0] for r in df.select(quality.repeated_words(quality.words(df.text))).collect()]
    assert got == [n for _, n in texts]


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
