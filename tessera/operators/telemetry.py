"""Cost and trace analytics: plain aggregations and windows.

A trace event has turn_id, seq, kind, payload (JSON), ts (seconds) and latency_ms; a cost event has model,
capability, tokens_in, tokens_out, latency_ms, session_id, turn_id and cost_usd; a turn has turn_id,
session_id, capability, success, latency_ms and cost_usd.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import join_checked, materialise


def values_at(rows: DataFrame, value: str, keys: list[str], places: dict[str, Callable[[Column], Column]], weight: str | None = None) -> DataFrame:
    """``keys`` and, by name, the values of each group at 0-based places of their order, which ``places`` finds from the group's size.

    Equal values are counted first; the counts are dealt out by ranges of key and value, and running sums go over the
    ranges and then within each, so that no task has a whole group. ``weight`` is how often a row counts. Null values
    are left out.
    """
    count = F.count("*") if weight is None else F.sum(weight)
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(count.alias("__c"))
    ranged = materialise(counted.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()), "ranged")
    marks = ranged.groupBy(*keys, "__part").agg(F.sum("__c").alias("__m"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    marks = marks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"), F.sum("__m").over(W.partitionBy(*keys)).alias("__size"))
    met = F.col("__part") == F.col("__p")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = W.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.join(marks, met).withColumn("__to", F.col("__start") + F.sum("__c").over(within))
    here = lambda at: (at(F.col("__size")) < F.col("__to")) & (at(F.col("__size")) >= F.col("__to") - F.col("__c"))
    found = [F.max(F.when(here(at), F.col("__v"))).alias(name) for name, at in places.items()]
    return placed.groupBy(*keys).agg(*found, F.max("__size").alias("n"))


def percentile_cont(rows: DataFrame, value: str, shares: list[float], keys: list[str], weight: str | None = None) -> DataFrame:
    """``keys``, interpolated percentiles ``p50``, ... and the number ``n`` of values that are not null."""
    at = lambda p, n: F.lit(p) * (n - 1)
    places = {}
    for p in shares:
        places |= {f"__low{p}": lambda n, p=p: F.floor(at(p, n)), f"__high{p}": lambda n, p=p: F.ceil(at(p, n))}
    found = values_at(rows, value, keys, places, weight)
    part = lambda p: at(p, F.col("n")) - F.floor(at(p, F.col("n")))
    low, high = (lambda p, end=end: F.col(f"`__{end}{p}`").cast("double") for end in ("low", "high"))
    return found.select(*keys, *[(low(p) + (high(p) - low(p)) * part(p)).alias(f"p{round(p * 100)}") for p in shares], "n")


def estimate_cost(events: DataFrame, pricing: DataFrame, default: str = "default") -> DataFrame:
    """``events`` with ``estimated``: tokens at the model's rate for a million, else at the default's.

    ``pricing(model, input, output)`` has a row a model, one of them the default's.
    """
    rates = pricing.select(F.col("model").alias("__m"), F.col("input").alias("__i"), F.col("output").alias("__o"))
    fallback = pricing.filter(F.col("model") == default).select(F.col("input").alias("__di"), F.col("output").alias("__do"))
    rows = join_checked(events, rates, F.col("model") == F.col("__m"), "left").join(F.broadcast(fallback), F.lit(True), "left")
    cost = (F.col("tokens_in") * F.coalesce("__i", "__di") + F.col("tokens_out") * F.coalesce("__o", "__do")) / 1e6
    return rows.withColumn("estimated", F.coalesce(cost, F.lit(0.0))).drop("__m", "__i", "__o", "__di", "__do")


def fill_cost(events: DataFrame, pricing: DataFrame) -> DataFrame:
    """``events`` whose zero costs are estimated."""
    rows = estimate_cost(events, pricing)
    return rows.withColumn("cost_usd", F.when(F.coalesce("cost_usd", F.lit(0.0)) == 0, F.col("estimated")).otherwise(F.col("cost_usd"))).drop("estimated")


def cost_total(events: DataFrame) -> DataFrame:
    """Total cost and number of events."""
    return events.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count("*").alias("events"))


def _roll(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg("cost_usd").alias("avg_cost_usd"),
    )


def cost_by_capability(events: DataFrame) -> DataFrame:
    """Calls, tokens, cost, mean latency and mean cost of each capability."""
    return _roll(events, "capability")


def cost_by_model(events: DataFrame) -> DataFrame:
    """The same of each model."""
    return _roll(events, "model")


def session_cost(events: DataFrame) -> DataFrame:
    """Cost of each session."""
    return events.groupBy("session_id").agg(F.sum("cost_usd").alias("cost_usd"))


def cost_summary(events: DataFrame) -> DataFrame:
    """The total and both groupings in one pass; ``level`` is total, capability or model."""
    rows = events.groupingSets([[], ["capability"], ["model"]], "capability", "model").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "capability").otherwise("model")
    return rows.select(level.alias("level"), "capability", "model", "calls", "cost_usd")


def get_turn(events: DataFrame, turn_id: str) -> DataFrame:
    """One turn's events in order."""
    return events.filter(F.col("turn_id") == turn_id).orderBy("seq")


def list_turns(events: DataFrame, limit: int = 20) -> DataFrame:
    """The newest turns: events, seconds, errors."""
    rows = events.groupBy("turn_id").agg(F.count("*").alias("events"), F.min("ts").alias("started"), (F.max("ts") - F.min("ts")).alias("wall_s"), F.count_if(F.col("kind") == "error").alias("errors"))
    return rows.orderBy(F.desc("started"), "turn_id").limit(limit)


def turn_header(events: DataFrame) -> DataFrame:
    """Milliseconds (0 for one event) and errors of each turn."""
    return events.groupBy("turn_id").agg(F.when(F.count("*") > 1, (F.max("ts") - F.min("ts")) * 1000).otherwise(F.lit(0.0)).alias("wall_ms"), F.count_if(F.col("kind") == "error").alias("errors"))


def turn_latency(events: DataFrame) -> DataFrame:
    """Summed latency beside wall time."""
    return events.groupBy("turn_id").agg(F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("latency_ms"), ((F.max("ts") - F.min("ts")) * 1000).alias("wall_ms"), F.count_if(F.col("kind") == "error").alias("errors"))


def latency_by_kind(events: DataFrame, since: float | None = None) -> DataFrame:
    """Interpolated p50 and p95 of each kind from a cutoff on, null latencies left out."""
    rows = events.filter("latency_ms is not null")
    rows = rows if since is None else rows.filter(F.col("ts") >= since)
    return percentile_cont(rows, "latency_ms", [0.5, 0.95], ["kind"])


def events_of_kind(events: DataFrame, kind: str) -> DataFrame:
    """Events of one kind."""
    return events.filter(F.col("kind") == kind)


def has_errors(events: DataFrame) -> DataFrame:
    """Whether a turn has an error."""
    return events.groupBy("turn_id").agg(F.bool_or(F.col("kind") == "error").alias("has_errors"))


def dump_lines(events: DataFrame, cut: int = 120) -> DataFrame:
    """One line of text for each event."""
    return events.select("turn_id", "seq", F.format_string("[%d] %s %s", F.col("seq"), F.col("kind"), F.substring("payload", 1, cut)).alias("line"))


def assign_seq(events: DataFrame, tie: str) -> DataFrame:
    """Sequence numbers from 0 within each turn, by time and ``tie``."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("turn_id").orderBy("ts", tie)) - 1)


def append_events(store: DataFrame, new: DataFrame) -> DataFrame:
    """``store`` and those of ``new`` whose (turn_id, seq) it does not hold."""
    key = ["turn_id", "seq"]
    return store.unionByName(new.dropDuplicates(key).join(store.select(*key), key, "left_anti"))


def success_rate(turns: DataFrame) -> DataFrame:
    """Share of successful turns; 0 for none."""
    return turns.agg(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"))


def percentile_nearest(rows: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at place min(int(n * p), n - 1) of the sorted ones, 0-based.

    Groups may be large: see :func:`values_at`.
    """
    place = lambda p: lambda n: F.least(F.floor(n * F.lit(p)), n - 1)
    found = values_at(rows, value, keys or [], {f"p{round(p * 100)}": place(p) for p in shares})
    return found.drop("n")


def latency_summary(rows: DataFrame, value: str = "latency_ms", keys: list[str] | None = None) -> DataFrame:
    """min, max, mean and interpolated p50, p95, p99."""
    keys = keys or []
    base = rows.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    shares = percentile_cont(rows, value, [0.5, 0.95, 0.99], keys).drop("n")
    if not keys:
        return base.join(F.broadcast(shares), F.lit(True), "left")  # one row each
    shares = shares.select(*[F.col(k).alias(f"__{k}") for k in keys], "p50", "p95", "p99")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return base.join(shares, met, "left").drop(*[f"__{k}" for k in keys])


def cost_per_task(turns: DataFrame, capability: str | None = None) -> DataFrame:
    """Mean cost of a turn, of all or of one capability."""
    rows = turns if capability is None else turns.filter(F.col("capability") == capability)
    return rows.agg(F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("cost_per_task"))


def eval_by_capability(turns: DataFrame) -> DataFrame:
    """Turns, success rate, nearest-rank p50 and p95 and mean cost of each capability."""
    base = turns.groupBy("capability").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("cost_usd").alias("avg_cost_usd"))
    return base.join(percentile_nearest(turns, "latency_ms", [0.5, 0.95], ["capability"]), "capability", "left")


def eval_summary(turns: DataFrame) -> DataFrame:
    """The same of all turns."""
    base = turns.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("avg_cost_usd"))
    return base.join(F.broadcast(percentile_nearest(turns, "latency_ms", [0.5, 0.95])), F.lit(True), "left")


def slow_trace_bottleneck(events: DataFrame, seconds: float = 5.0, trace: str = "trace_id", agent: str = "agent_id") -> DataFrame:
    """p95 latency by agent and kind within traces that last longer than ``seconds``."""
    slow = events.groupBy(trace).agg((F.max("ts") - F.min("ts")).alias("__s")).filter(F.col("__s") > seconds).select(trace)
    rows = events.join(slow, trace, "left_semi").filter("latency_ms is not null")
    return percentile_cont(rows, "latency_ms", [0.95], [agent, "kind"])


def flatten_payload(payload: Column, cut: int = 256) -> Column:
    """A JSON object as a map with ``payload.`` before its keys and values cut as strings."""
    found = F.from_json(payload, "map<string,string>")
    return F.transform_values(F.transform_keys(found, lambda k, v: F.concat(F.lit("payload."), k)), lambda k, v: F.substring(v, 1, cut))


def failure_streaks(rows: DataFrame, key: str, order: list[str], success: str = "success", least: int = 3) -> DataFrame:
    """``(key, island, failures, first, last)``: runs of at least ``least`` failures up to a success."""
    at = W.partitionBy(key).orderBy(*order)
    island = F.sum(F.col(success).cast("int")).over(at.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("island", island).filter(~F.col(success))
    out = marked.groupBy(key, "island").agg(F.count("*").alias("failures"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return out.filter(F.col("failures") >= least)


def gap_report(turns: DataFrame, gaps: str = "gaps", topic: str = "topic") -> DataFrame:
    """Turns that name a gap, by topic."""
    return turns.filter(F.trim(F.coalesce(gaps, F.lit(""))) != "").groupBy(topic).agg(F.count("*").alias("n"))


def turn_status(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """``(turn_id, status, seconds)`` from opening rows (turn_id, ts) and closing rows (turn_id, ts, outcome)."""
    done = closed.select("turn_id", F.col("ts").alias("end"), "outcome")
    status = F.when(F.col("outcome").isNull(), "open").when(F.col("outcome") == "error", "failed").when(F.col("outcome") == "escalated", "escalated").otherwise("completed")
    return opened.join(done, "turn_id", "left").select("turn_id", status.alias("status"), (F.col("end") - F.col("ts")).alias("seconds"))
