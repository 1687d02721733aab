"""Streaming forms: event append, windowed roll-ups, sessions, and per-key state."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.operators.assemble import assemble
from tessera.operators.telemetry import estimate_cost, percentile_cont

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, as the stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events once for each (turn_id, seq) within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["turn_id", "seq"])


def stream_cost(events: DataFrame, pricing: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Calls and cost of each window and capability."""
    rows = estimate_cost(events.withWatermark("ts", delay), pricing)
    return rows.groupBy(F.window("ts", window), "capability").agg(F.count("*").alias("calls"), F.sum("estimated").alias("cost_usd"))


def stream_latency(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """How often each latency came in each window and kind, ``(window, kind, latency_ms, n)``; :func:`latency_of_counts` reads them.

    State is one small row for each of these, and no list of a window's values.
    """
    rows = events.withWatermark("ts", delay).filter("latency_ms is not null")
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(frame, "kind", "latency_ms").agg(F.count("*").alias("n"))


def latency_of_counts(counts: DataFrame) -> DataFrame:
    """p50, p95 and number of each window and kind, from the newest rows of :func:`stream_latency`."""
    newest = counts.groupBy("window", "kind", "latency_ms").agg(F.max("n").alias("times"))
    return percentile_cont(newest, "latency_ms", [0.5, 0.95], ["window", "kind"], weight="times")


#: Size of a quantile sketch: a quantile's rank is off by 1.65 % of the number of values at most, with 99 % confidence.
SKETCH_K = 200


def stream_latency_sketch(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", k: int = SKETCH_K) -> DataFrame:
    """``(window, kind, sketch, n)``: a mergeable quantile sketch of each window and kind, whose state is one bounded row each."""
    rows = events.withWatermark("ts", delay).filter("latency_ms is not null")
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(frame, "kind").agg(F.kll_sketch_agg_double("latency_ms", k).alias("sketch"), F.count("*").alias("n"))


def latency_of_sketches(rows: DataFrame, by: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """Quantiles (p50 and p95, or ``shares`` by name) and numbers by ``by``, sketches of smaller groups merged; one row a group before."""
    merged = rows.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    found = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in (shares or {"p50": 0.5, "p95": 0.95}).items()}
    return merged.select(*by, *[c.alias(name) for name, c in found.items()], "n")


def once_by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink whose batches have folders of their own under ``path``: a batch that comes again writes over itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What :func:`once_by_batch` has written."""
    return spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(path).drop("batch")


def stream_turn_status(opened: DataFrame, closed: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``(turn_id, status, seconds)`` of streams of opening rows (turn_id, ts) and closing rows (turn_id, ts, outcome).

    A turn is closed by the row of its id that comes at most ``within`` after it by event time. One without is failed as
    soon as the watermarks of both streams, ``delay`` behind, have passed that time; both sides' state goes then.
    """
    left = opened.select("turn_id", "ts").withWatermark("ts", delay)
    right = closed.select(F.col("turn_id").alias("of"), F.col("ts").alias("end"), "outcome").withWatermark("end", delay)
    same = F.expr(f"turn_id = of AND end >= ts AND end <= ts + INTERVAL {within}")
    status = F.when(F.col("end").isNull() | (F.col("outcome") == "error"), "failed").when(F.col("outcome") == "escalated", "escalated").otherwise("completed")
    return left.join(right, same, "left_outer").select("turn_id", status.alias("status"), (F.col("end").cast("double") - F.col("ts").cast("double")).alias("seconds"))


def late_rows(query) -> int:
    """Rows that a stream has left out because they came behind the watermark, over all its batches."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", delay: str | None = None) -> DataFrame:
    """Spans of activity of each key with no longer gap; batch, or streaming with a watermark."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(key, F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("events"))


def stream_min_score(rows: DataFrame, least: float) -> DataFrame:
    """Rows whose score is high enough."""
    return rows.filter(F.col("score") >= least)


def _signature(text: str, seeds: np.ndarray) -> np.ndarray:
    """MinHash values of a text's token set; of one without tokens all are the same."""
    tokens = sorted(set(text.lower().split())) or [""]
    own = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens], np.uint64)
    return ((own[:, None] * seeds[0] + seeds[1]) >> np.uint64(32)).min(0).astype(np.uint32)


#: MinHash values of an item: bands, and values of a band. Two items at a Jaccard index of 0.9 share a band with
#: probability 0.9999; the index is then estimated by the share of equal values, within 0.03 or so.
BANDS, BAND_VALUES = 16, 8
#: Kept items of a key that are read at once, one MB; a call to the state costs more than the comparison with all of them.
HELD = 2048
#: Days for which an item is remembered.
REMEMBERED_DAYS = 7


class _Dedup(StatefulProcessor):
    """Remembers the signatures of kept items, and passes on what is unlike those it shares a band with.

    The first :data:`HELD` signatures of a key are a list, which is read once and added to once for each part of its rows.
    Further ones are looked up by band, so that a key's memory is bounded.
    """

    def __init__(self, threshold: float, ttl_ms: int | None):
        self.threshold, self.ttl_ms = threshold, ttl_ms
        rng = np.random.default_rng(7)
        self.seeds = rng.integers(1, 1 << 63, (2, BANDS * BAND_VALUES), dtype=np.uint64) | np.uint64(1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "signatures binary", self.ttl_ms)
        self.bands = handle.getMapState("bands", "band string", "signature binary", self.ttl_ms)

    def _alike(self, held: np.ndarray, own: np.ndarray) -> bool:
        same = held == own
        return bool((same.reshape(-1, BANDS, BAND_VALUES).all(2).any(1) & (same.mean(1) >= self.threshold)).any())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before = np.frombuffer(b"".join(bytes(x[0]) for x in self.held.get()), np.uint32).reshape(-1, BANDS * BAND_VALUES)
        n, held = len(before), np.empty((max(8, 2 * len(before)), BANDS * BAND_VALUES), np.uint32)
        held[:n] = before
        more = (n >= HELD or self.ttl_ms is not None) and self.bands.exists()  # some were kept when the list was full, which may have expired since
        for part in rows:
            chosen, known = [], n
            for i, text in enumerate(part["text"]):
                own = _signature("" if text is None else str(text), self.seeds)
                if n and self._alike(held[:n], own):
                    continue
                names = [(f"{b}:{own[b * BAND_VALUES : (b + 1) * BAND_VALUES].tobytes().hex()}",) for b in range(BANDS)] if more or n >= HELD else []
                found = {self.bands.getValue(x)[0] for x in names if self.bands.containsKey(x)} if more else ()
                if any((np.frombuffer(bytes(x), np.uint32) == own).mean() >= self.threshold for x in found):
                    continue
                if n < HELD:
                    if n == len(held):
                        held = np.concatenate([held, np.empty_like(held)])
                    held[n], n = own, n + 1
                else:
                    for x in names:
                        self.bands.updateValue(x, (own.tobytes(),))
                    more = True
                chosen.append(i)
            if n > known:
                self.held.appendValue((held[known:n].tobytes(),))
            if chosen:
                yield part if len(chosen) == len(part) else part.iloc[chosen]

    def close(self) -> None:
        pass


def stream_dedup(rows: DataFrame, threshold: float = 0.9, key: str = "query_id", ttl_ms: int | None = REMEMBERED_DAYS * 86_400_000) -> DataFrame:
    """Rows unlike the kept rows of their key that came within ``ttl_ms`` before.

    A kept row is remembered as its MinHash signature, 512 bytes of state whatever its length, or after the first
    :data:`HELD` of a key as its 16 bands, about 12 KB, for ``ttl_ms`` of processing time. Token sets alike to 0.9 or more are found with the recall of :data:`BANDS`; null
    texts are empty ones, and empty ones alike. With ``ttl_ms`` None nothing is forgotten, which is for streams that end:
    a query with a time to live runs on for its timers, also when it is to take what is there and stop.
    """
    return rows.groupBy(key).transformWithStateInPandas(_Dedup(threshold, ttl_ms), rows.schema, "Append", "ProcessingTime" if ttl_ms else "None")


class _TopK(StatefulProcessor):
    """Holds the k best rows of a key."""

    def __init__(self, k: int, fields: list[str], schema: StructType):
        self.k, self.fields, self.schema = k, fields, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.best.get()] if self.best.exists() else []
        frame = pd.concat([pd.DataFrame(held, columns=self.fields), *rows], ignore_index=True) if held else pd.concat(list(rows), ignore_index=True)
        frame = frame.sort_values("score", ascending=False, kind="stable").head(self.k)
        self.best.put([tuple(x) for x in frame.itertuples(index=False)])
        frame = frame.copy()
        frame["rank"] = range(1, len(frame) + 1)
        yield frame

    def close(self) -> None:
        pass


def stream_topk(rows: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """The k best rows of each key so far, sent anew whenever the key has new rows (update mode)."""
    out = StructType([*rows.schema.fields]).add("rank", "long")
    return rows.groupBy(key).transformWithStateInPandas(_TopK(k, rows.columns, rows.schema), out, "Update", "None")


class _Context(StatefulProcessor):
    """Keeps what was unlike all before it, and sends a key's k best of that whenever it has new rows."""

    def __init__(self, k: int, least: float, threshold: float, fields: list[str], schema: StructType):
        self.k, self.least, self.fields, self.schema = k, least, fields, schema
        self.dedup = _Dedup(threshold, None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.dedup.init(handle)
        self.best = handle.getListState("best", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        good = (part if ok.all() else part[ok].reset_index(drop=True) for part in rows for ok in [(part["score"] >= self.least).to_numpy(bool)] if ok.any())
        best = None  # of those that were kept before and of each part, the k best so far
        for part in self.dedup.handleInputRows(key, good, timers):
            if best is None:
                held = [tuple(x) for x in self.best.get()]
                best = pd.concat([pd.DataFrame(held, columns=self.fields), part], ignore_index=True) if held else part
            else:
                best = pd.concat([best, part], ignore_index=True)
            best = best.iloc[np.argsort(-best["score"].to_numpy(float), kind="stable")[: self.k]]
        if best is not None:
            self.best.put(list(best.itertuples(index=False, name=None)))
            yield best.assign(rank=np.arange(1, len(best) + 1))

    def close(self) -> None:
        pass


def stream_context(rows: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 5, least: float = 0.0, threshold: float = 0.95, key: str = "query_id", **options):
    """A writer that leaves out low scores and near-duplicates of kept rows, and hands the contexts of the k best to ``sink``.

    What was kept and what is best are state: a query's context is made of all its rows so far, and is sent anew in
    each batch that changes it.
    """
    out = StructType([*rows.schema.fields]).add("rank", "integer")
    best = rows.groupBy(key).transformWithStateInPandas(_Context(k, least, threshold, rows.columns, rows.schema), out, "Update", "None")

    def each(batch: DataFrame, number: int) -> None:
        sink(assemble(batch, threshold=1.01, **options), number)

    return best.writeStream.outputMode("update").foreachBatch(each)


class _TurnIndex(StatefulProcessor):
    """Counts the turns of a conversation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        for part in rows:
            part = part.copy()
            part["turn_index"] = range(n + 1, n + 1 + len(part))
            n += len(part)
            yield part
        self.count.update((n,))

    def close(self) -> None:
        pass


def stream_turn_index(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Rows with their turn's number, from 1."""
    return rows.groupBy(key).transformWithStateInPandas(_TurnIndex(), StructType([*rows.schema.fields]).add("turn_index", "long"), "Append", "None")


class _Compact(StatefulProcessor):
    """Holds recent turns and the summary; folds the older ones when there are too many."""

    def __init__(self, key: str, summarise: Callable[[str, list[str]], str], threshold: int, keep: int):
        self.key, self.summarise, self.threshold, self.keep = key, summarise, threshold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "text string")
        self.summary = handle.getValueState("summary", "text string, turns long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        said, turns = self.summary.get() if self.summary.exists() else ("", 0)
        out = []
        for part in rows:
            for text in part["text"]:
                held.append(str(text))
                if len(held) > self.threshold:
                    folded, held = held[: -self.keep], held[-self.keep :]
                    said, turns = self.summarise(said, folded), turns + len(folded)
                    out.append((key[0], turns, said))
        self.recent.put([(x,) for x in held])
        self.summary.update((said, turns))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "up_to_turn", "summary"])

    def close(self) -> None:
        pass


def join_beginnings(said: str, texts: list[str]) -> str:
    """A summary without a model."""
    return " | ".join([*([said] if said else []), *(t[:80] for t in texts)])


def stream_compact(rows: DataFrame, summarise: Callable[[str, list[str]], str] = join_beginnings, threshold: int = 8, keep: int = 5, key: str = "conversation_id") -> DataFrame:
    """``(conversation_id, up_to_turn, summary)`` whenever more than ``threshold`` turns are held."""
    schema = StructType([rows.schema[key]]).add("up_to_turn", "long").add("summary", "string")
    return rows.groupBy(key).transformWithStateInPandas(_Compact(key, summarise, threshold, keep), schema, "Append", "None")


class _Streaks(StatefulProcessor):
    """Counts failures in a row."""

    def __init__(self, key: str, least: int):
        self.key, self.least = key, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n = self.run.get()[0] if self.run.exists() else 0
        out = []
        for part in rows:
            for success in part["success"]:
                n = 0 if success else n + 1
                if n == self.least:
                    out.append((key[0], n))
        self.run.update((n,))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "failures"])

    def close(self) -> None:
        pass


def stream_streaks(rows: DataFrame, least: int = 3, key: str = "user_id") -> DataFrame:
    """A row whenever a key has failed ``least`` times in a row."""
    return rows.groupBy(key).transformWithStateInPandas(_Streaks(key, least), StructType([rows.schema[key]]).add("failures", "long"), "Append", "None")


def token_column(rows: DataFrame, text: str = "text") -> DataFrame:
    """Whitespace words, in batch and in streams alike."""
    return rows.withColumn("tokens", T.token_count(F.col(text)))
