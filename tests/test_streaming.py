"""Streams drained into memory give what batches give."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as K

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    K.use_rocksdb(spark)
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{DATA}/events.parquet")
    rows = e.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.concat_ws("-", "user_id", F.date_format("ts", "dd")).alias("turn_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"))
    rows = rows.union(rows.limit(50)).coalesce(1)
    rows.write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, source):
    return spark.readStream.schema(source[1].schema).parquet(source[0])


def test_events_once(spark, source):
    got = drain(spark, K.stream_events(stream(spark, source)), "once")
    assert got.count() == source[1].dropDuplicates(["turn_id", "seq"]).count() < source[1].count()


def test_latency_and_cost_windows(spark, source):
    got = K.latency_of_counts(drain(spark, K.stream_latency(stream(spark, source), "1 day"), "latency", "update"))
    exact = [F.round(F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY latency_ms)"), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))]
    want = source[1].groupBy(F.window("ts", "1 day"), "kind").agg(*exact, F.count("*").alias("n"))
    got = got.select("window", "kind", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    pricing = spark.createDataFrame([("default", 1.0, 1.0)], "model string, input double, output double")
    calls = stream(spark, source).selectExpr("ts", "'m' model", "kind capability", "1000000 tokens_in", "0 tokens_out")
    cost = drain(spark, K.stream_cost(calls, pricing, "365 days"), "cost", "complete")
    assert cost.agg(F.sum("cost_usd")).first()[0] == pytest.approx(source[1].count())


def test_sessions(spark, source):
    batch = K.sessions(source[1], "2 hours")
    assert batch.agg(F.sum("events")).first()[0] == source[1].count()


def small(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_dedup_and_topk(spark, tmp_path):
    K.use_rocksdb(spark)
    rows = [(1, "a b c d", 0.5), (1, "a b c d", 0.9), (1, "x y", 0.7), (2, "a b c d", 0.1)]
    df = small(spark, tmp_path, rows, "query_id long, text string, score double")
    assert sorted(r.text for r in drain(spark, K.stream_dedup(df, ttl_ms=None), "dedup").collect()) == ["a b c d", "a b c d", "x y"]
    best = drain(spark, K.stream_topk(K.stream_min_score(df, 0.2), 2), "topk", "update")
    assert sorted((r.query_id, r.score, r.rank) for r in best.collect()) == [(1, 0.7, 2), (1, 0.9, 1)]


def test_turn_index_compaction_and_streaks(spark, tmp_path):
    K.use_rocksdb(spark)
    df = small(spark, tmp_path, [(1, f"t{i}", i < 2) for i in range(6)], "conversation_id long, text string, success boolean")
    assert sorted(r.turn_index for r in drain(spark, K.stream_turn_index(df), "turns").collect()) == [1, 2, 3, 4, 5, 6]
    got = drain(spark, K.stream_compact(df, threshold=4, keep=2), "compact").collect()
    assert [(r.up_to_turn, r.summary) for r in got] == [(3, "t0 | t1 | t2")]
    assert [r.failures for r in drain(spark, K.stream_streaks(df, 3, "conversation_id"), "streaks").collect()] == [3]


def batches(spark, tmp_path, parts, schema):
    """A stream that takes one part after the other."""
    path = tmp_path / "parts"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        new = max(path.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        import os

        os.utime(new, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_context_is_kept_across_batches(spark, tmp_path):
    K.use_rocksdb(spark)
    parts = [
        [(1, 10, "ch", "some text", 0.9), (1, 11, "ch", "more words", 0.8), (2, 12, "ch", "low", 0.1)],
        [(1, 13, "ch", "some text", 0.95), (1, 14, "ch", "third thing", 0.85), (3, 15, "ch", "other", 0.5)],
        [(1, 16, "ch", "more words", 0.99)],
    ]
    df = batches(spark, tmp_path, parts, "query_id long, doc_id long, chapter string, text string, score double")
    seen = []
    q = K.stream_context(df, lambda out, n: seen.extend((n, r.query_id, r.context) for r in out.collect()), k=2, least=0.2, strategy="naive").trigger(availableNow=True).start()
    q.awaitTermination(120)
    head = "Relevant knowledge:\n\n"
    assert sorted(seen) == [(0, 1, f"{head}some text\n\nmore words"), (1, 1, f"{head}some text\n\nthird thing"), (1, 3, f"{head}other")]


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    parts = [[(at(0), "a", 1), (at(200), "a", 2)], [(at(210), "a", 3)], [(at(5), "a", 4), (at(7), "b", 5), (at(220), "b", 6)]]
    df = batches(spark, tmp_path, parts, "ts timestamp, turn_id string, seq int")
    q = K.stream_events(df, "10 minutes").writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.seq for r in spark.table("late").collect()) == [1, 2, 3, 6] and K.late_rows(q) == 2


def test_sessions_as_a_stream(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    parts = [[("a", at(0)), ("a", at(20))], [("a", at(45)), ("b", at(50))], [("a", at(300))], [("b", at(600))]]
    df = batches(spark, tmp_path, parts, "user_id string, ts timestamp")
    got = drain(spark, K.sessions(df, "30 minutes", delay="5 minutes"), "spans")
    assert sorted((r.user_id, r.session.start, r.events) for r in got.collect()) == [("a", at(0), 3), ("a", at(300), 1), ("b", at(50), 1)]


def test_sketches_are_near_the_exact_quantiles_and_state_is_bounded(spark, source):
    df = K.stream_latency_sketch(stream(spark, source), "6 hours")
    q = df.writeStream.outputMode("complete").format("memory").queryName("sketches").trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = spark.table("sketches")
    assert held.count() == source[1].groupBy(F.window("ts", "6 hours"), "kind").count().count() == max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"])
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for by in ([], ["kind"]):
        for r in K.latency_of_sketches(held, by, shares).collect():
            values = [x.latency_ms for x in source[1].filter(F.lit(True) if not by else F.col("kind") == r.kind).select("latency_ms").collect()]
            assert r.n == len(values)
            for name, p in shares.items():
                low, high = sum(v < r[name] for v in values) / r.n, sum(v <= r[name] for v in values) / r.n
                assert low - 0.0165 <= p <= high + 0.0165


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "a int"
    write = K.once_by_batch(path)
    first, second = (spark.createDataFrame([(i,) for i in r], schema) for r in (range(5), range(5, 9)))
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(batch, number)
    got = K.read_batches(spark, path, first.schema)
    assert got.columns == ["a"] and sorted(r.a for r in got.collect()) == list(range(9))


def test_turns_are_closed_by_a_join_of_streams(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    (tmp_path / "o").mkdir()
    (tmp_path / "c").mkdir()
    opened = batches(spark, tmp_path / "o", [[(1, at(0)), (2, at(1)), (3, at(2)), (4, at(3))], [(5, at(40))], [(9, at(500))], [(10, at(501))]], "turn_id int, ts timestamp")
    closed = batches(spark, tmp_path / "c", [[(1, at(5), "ok")], [(2, at(30), "error"), (3, at(45), "escalated")], [(4, at(400), "ok")], [(9, at(502), "ok")]], "turn_id int, ts timestamp, outcome string")
    got = drain(spark, K.stream_turn_status(opened, closed, "1 hour", "5 minutes"), "status").collect()
    assert sorted((r.turn_id, r.status, r.seconds) for r in got) == [(1, "completed", 300.0), (2, "failed", 1740.0), (3, "escalated", 2580.0), (4, "failed", None), (5, "failed", None), (9, "completed", 120.0)]


def test_banded_dedup_is_near_the_exact_one(spark, tmp_path):
    import random

    K.use_rocksdb(spark)
    rng, rows = random.Random(3), []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        rows.append((1, " ".join(words)))
        for n in (0, 1, 30):  # as it is, one word of 60 changed (0.967), half of them (0.33)
            rows.append((1, " ".join(["new" + str(i)] * n + words[n:]) if n else " ".join(reversed(words))))
    rows += [(2, None), (2, ""), (2, " "), (3, rows[0][1])]
    df = small(spark, tmp_path, rows, "query_id long, text string")
    got = drain(spark, K.stream_dedup(df, 0.9, ttl_ms=None), "banded").collect()
    want, kept = 0, {}
    for key, text in rows:
        tokens = set((text or "").lower().split())
        if not any((len(tokens & k) / len(tokens | k) if tokens | k else 1.0) >= 0.9 for k in kept.setdefault(key, [])):
            kept[key].append(tokens)
            want += 1
    assert want <= len(got) <= want + 4  # of 80 copies at 0.97 or more at most 4 are not seen


def test_dedup_forgets_what_is_old(spark, tmp_path):
    K.use_rocksdb(spark)
    df = batches(spark, tmp_path, [[(1, "a b c d")], [(1, "a b c d"), (1, "x y")]], "query_id long, text string")
    for name, ttl, want in (("short", 1, 3), ("long", 3_600_000, 2)):
        q = K.stream_dedup(df, ttl_ms=ttl).writeStream.format("memory").queryName(name).trigger(processingTime="1 second").start()
        try:
            for _ in range(60):
                if sum(p["numInputRows"] for p in q.recentProgress) == 3:
                    break
                q.awaitTermination(1)
        finally:
            q.stop()
        assert spark.table(name).count() == want


class FakeState:
    """A list or a map of one key that counts the calls to it."""

    def __init__(self):
        self.calls, self.rows, self.pairs = 0, [], {}

    def getListState(self, *_):
        self.listed = FakeState()
        return self.listed

    def getMapState(self, *_):
        self.mapped = FakeState()
        return self.mapped

    def __getattr__(self, name):
        does = {
            "get": lambda: iter(self.rows),
            "exists": lambda: bool(self.rows or self.pairs),
            "appendValue": lambda x: self.rows.append(x),
            "put": lambda x: self.rows.__setitem__(slice(None), x),
            "containsKey": lambda k: k in self.pairs,
            "getValue": lambda k: self.pairs.get(k),
            "updateValue": lambda k, x: self.pairs.__setitem__(k, x),
        }
        if name not in does:
            raise AttributeError(name)
        self.calls += 1
        return does[name]


def kept_texts(processor, texts, size):
    """What a processor passes on of one key's texts, which come in parts of a batch each."""
    parts = [pd.DataFrame({"text": texts[i : i + size], "score": 1.0}) for i in range(0, len(texts), size)]
    return [t for p in parts for out in processor.handleInputRows((1,), iter([p]), None) for t in out["text"]]


def test_dedup_calls_its_state_by_parts_not_by_rows():
    processor, state = K._Dedup(0.9, None), FakeState()
    processor.init(state)
    texts = [f"word{i} text{i} of{i} its{i} own{i}" for i in range(300)]
    assert kept_texts(processor, [*texts, *texts], 100) == texts
    assert state.listed.calls + state.mapped.calls <= 6 * 3 and len(b"".join(x[0] for x in state.listed.rows)) == 300 * 512


@pytest.mark.parametrize("ttl_ms", [None, 1000])
def test_dedup_beyond_the_list(monkeypatch, ttl_ms):
    texts = [f"word{i} text{i} of{i} its{i} own{i}" for i in range(30)]
    for held in (1, 7, 2048):
        monkeypatch.setattr(K, "HELD", held)
        processor, state = K._Dedup(0.9, ttl_ms), FakeState()
        processor.init(state)
        assert kept_texts(processor, [*texts[:20], *texts, None, "", *texts], 8) == [*texts, None]
        assert len(b"".join(x[0] for x in state.listed.rows)) == min(held, 31) * 512
        assert len(state.mapped.pairs) == 16 * (31 - min(held, 31))
        # The list's rows expire: those that were looked up by band are still known, and the list is filled anew.
        if ttl_ms:
            state.listed.rows.clear()
            assert kept_texts(processor, texts, 8) == texts[: min(held, 30)]


def test_context_holds_the_best_of_all_parts_with_two_calls_a_batch():
    lists = []

    class Handle(FakeState):
        def getListState(self, *_):
            lists.append(FakeState())
            return lists[-1]

    fields = ["query_id", "text", "score"]
    processor = K._Context(3, 0.2, 0.95, fields, None)
    processor.init(Handle())
    best = lists[-1]
    rows = [(1, f"word{i} text{i} of{i} its{i}", s) for i, s in enumerate([0.3, 0.1, None, 0.5, 0.5, 0.9, 0.2, 0.5, 0.1, 0.1, 0.95, 0.3])]
    send = lambda part: [out for out in processor.handleInputRows((1,), (pd.DataFrame(part[i : i + 2], columns=fields) for i in range(0, len(part), 2)), None)]
    (first,) = send(rows[:8])
    assert [(t.split()[0], s, r) for t, s, r in zip(first["text"], first["score"], first["rank"])] == [("word5", 0.9, 1), ("word3", 0.5, 2), ("word4", 0.5, 3)]
    assert best.calls == 2 and send(rows[8:10]) == [] and best.calls == 2
    (last,) = send(rows[10:])
    assert last["text"].str.split().str[0].tolist() == ["word10", "word5", "word3"] and best.calls == 4
