import duckdb
import pandas as pd
import pytest

from tessera.llm import mixing


def plain_targets(sizes):
    """Share by weight, stop, share what is above anew, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def rows():
    out = [(i, "w " * (i % 13), "big", i) for i in range(300)]
    out += [(1000 + i, "w " * 7, f"s{i % 4}", i) for i in range(40)]
    return [*out, (None, "a b c", None, 1), (5, None, "empty", 2), (7, "x\x0by\x0cz\tq", None, 3), *out[:3], (2000, "y " * 5000, "s0", 4)]


def test_mix(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, range_rows=16).toPandas()
    assert len(got) == len(rows())
    sizes = {}
    for _, text, source, _ in rows():
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    for source, part in got.groupby(got.source.fillna("<null>")):
        t = want[None if source == "<null>" else source]
        assert part.target.iloc[0] == pytest.approx(t)
        assert abs(part.taken.sum() - t) < 1.001
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source", "taken"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), again[key].sort_values(key).reset_index(drop=True))


def test_mix_matches_sql(spark):
    frame = pd.DataFrame(rows(), columns=["doc_id", "text", "source", "x"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("frame", frame)
    want = con.sql(mixing.MIX_SQL.replace("{docs}", "frame")).df()
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    a, b = (x[key].fillna(-1).sort_values(key).reset_index(drop=True).astype(float) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    zero = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.mix(zero).select("size", "target", "taken").collect()} == {(0, 0.0, 0)}
