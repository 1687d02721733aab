"""Queries over the events table as a trace and cost log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import telemetry as H
from tessera.plans.base import query, table

_MICROS = "epoch_us(ts)"


def trace(spark, sf_dir):
    """Events as a trace: a turn is a user's day."""
    e = table(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    turn = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    rows = e.select("event_id", turn.alias("turn_id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), ts.alias("ts"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("latency_ms"), "user_id")
    return H.assign_seq(rows, "event_id")


_RAW = "(SELECT event_id, user_id || '-' || strftime(ts, '%Y%m%d') AS turn_id, event_type AS kind, props AS payload, epoch_us(ts) / 1e6 AS ts, CASE WHEN event_id % 11 <> 0 THEN value END AS latency_ms, user_id FROM events)"
TRACE = f"(SELECT *, (row_number() OVER (PARTITION BY turn_id ORDER BY ts, event_id) - 1)::INT AS seq FROM {_RAW})"


def costs(spark, sf_dir):
    """Events as model calls; every third comes with a cost."""
    e = trace(spark, sf_dir)
    model = F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    tokens = F.floor(F.coalesce("latency_ms", F.lit(0.0)) * 10).cast("long")
    rows = e.select("event_id", model.alias("model"), F.col("kind").alias("capability"), tokens.alias("tokens_in"), F.floor(tokens / 3).cast("long").alias("tokens_out"), "latency_ms", F.col("user_id").cast("string").alias("session_id"), "turn_id", F.when(F.col("event_id") % 3 == 0, F.lit(0.25)).otherwise(0.0).alias("cost_usd"), "ts")
    return rows


def pricing(spark):
    """A price list."""
    return spark.createDataFrame([("small", 0.5, 1.5), ("large", 2.5, 10.0), ("default", 1.0, 2.0)], "model string, input double, output double")


_PRICES = "(VALUES ('small', 0.5, 1.5), ('large', 2.5, 10.0)) p(m, i, o)"
_CALLS = f"""(SELECT event_id, ['small', 'large', 'other'][event_id % 3 + 1] AS model, kind AS capability, floor(coalesce(latency_ms, 0) * 10)::BIGINT AS tokens_in, floor(floor(coalesce(latency_ms, 0) * 10) / 3)::BIGINT AS tokens_out,
 latency_ms, user_id::VARCHAR AS session_id, turn_id, CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE 0 END AS given, ts FROM {TRACE})"""
_ESTIMATED = f"(SELECT c.*, (tokens_in * coalesce(i, 1.0)::DOUBLE + tokens_out * coalesce(o, 2.0)::DOUBLE) / 1e6 AS estimated FROM {_CALLS} c LEFT JOIN {_PRICES} ON model = m)"
COSTS = f"(SELECT *, CASE WHEN given = 0 THEN estimated ELSE given::DOUBLE END AS cost_usd FROM {_ESTIMATED})"


def filled(spark, sf_dir):
    return H.fill_cost(costs(spark, sf_dir), pricing(spark))


def turns(spark, sf_dir):
    """A turn for each order-like group: the user's day, failed if its last event is an error."""
    t = trace(spark, sf_dir).groupBy("turn_id").agg(F.max("user_id").alias("session_id"), F.max_by("kind", "seq").alias("last"), F.min_by("kind", "seq").alias("capability"), F.sum("latency_ms").alias("latency_ms"), F.min("ts").alias("ts"))
    return t.select("turn_id", "session_id", "capability", (F.col("last") != "error").alias("success"), "latency_ms", (F.coalesce("latency_ms", F.lit(0.0)) / 1000).alias("cost_usd"), "ts")


TURNS = f"""(SELECT turn_id, session_id, capability, last <> 'error' AS success, latency_ms, coalesce(latency_ms, 0) / 1000 AS cost_usd, ts FROM
 (SELECT turn_id, max(user_id) AS session_id, arg_max(kind, seq) AS last, arg_min(kind, seq) AS capability, sum(latency_ms) AS latency_ms, min(ts) AS ts FROM {TRACE} GROUP BY turn_id))"""


def _r(rows, *names, places=6):
    """Floats rounded, so that the order of a sum does not show."""
    return rows.withColumns({n: F.round(n, places) for n in names})


@query(f"SELECT event_id, round(estimated, 9) AS estimated FROM {_ESTIMATED}")
def estimate_cost(spark, sf_dir):
    return _r(H.estimate_cost(costs(spark, sf_dir), pricing(spark)).select("event_id", "estimated"), "estimated", places=9)


@query(f"SELECT event_id, round(cost_usd, 9) AS cost_usd FROM {COSTS}")
def append_costs(spark, sf_dir):
    return _r(filled(spark, sf_dir).select("event_id", "cost_usd"), "cost_usd", places=9)


@query(f"SELECT round(sum(cost_usd), 6) AS cost_usd, count(*) AS events FROM {COSTS}")
def cost_total(spark, sf_dir):
    return _r(H.cost_total(filled(spark, sf_dir)), "cost_usd")


def _roll_sql(key):
    return f"SELECT {key}, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 6) AS cost_usd, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(cost_usd), 6) AS avg_cost_usd FROM {COSTS} GROUP BY {key}"


@query(_roll_sql("capability"))
def cost_by_capability(spark, sf_dir):
    return _r(H.cost_by_capability(filled(spark, sf_dir)), "cost_usd", "avg_latency_ms", "avg_cost_usd")


@query(_roll_sql("model"))
def cost_by_model(spark, sf_dir):
    return _r(H.cost_by_model(filled(spark, sf_dir)), "cost_usd", "avg_latency_ms", "avg_cost_usd")


@query(f"SELECT session_id, round(sum(cost_usd), 6) AS cost_usd FROM {COSTS} GROUP BY session_id")
def session_cost(spark, sf_dir):
    return _r(H.session_cost(filled(spark, sf_dir)), "cost_usd")


@query(f"SELECT CASE WHEN grouping(capability) = 1 AND grouping(model) = 1 THEN 'total' WHEN grouping(model) = 1 THEN 'capability' ELSE 'model' END AS level, capability, model, count(*) AS calls, round(sum(cost_usd), 6) AS cost_usd FROM {COSTS} GROUP BY GROUPING SETS ((), (capability), (model))")
def cost_summary(spark, sf_dir):
    return _r(H.cost_summary(filled(spark, sf_dir)), "cost_usd")


@query(f"SELECT turn_id, seq, kind, ts FROM {TRACE} WHERE turn_id = '8-20240101'")
def get_turn(spark, sf_dir):
    return H.get_turn(trace(spark, sf_dir), "8-20240101").select("turn_id", "seq", "kind", "ts")


@query(f"SELECT turn_id, count(*) AS events, min(ts) AS started, round(max(ts) - min(ts), 3) AS wall_s, count(*) FILTER (kind = 'error') AS errors FROM {TRACE} GROUP BY turn_id ORDER BY started DESC, turn_id LIMIT 20")
def list_turns(spark, sf_dir):
    return _r(H.list_turns(trace(spark, sf_dir)), "wall_s", places=3)


@query(f"SELECT kind, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, count(*) AS n FROM {TRACE} WHERE latency_ms IS NOT NULL AND ts >= 1705000000 GROUP BY kind")
def latency_by_kind(spark, sf_dir):
    return _r(H.latency_by_kind(trace(spark, sf_dir), 1705000000.0), "p50", "p95")


@query(f"SELECT turn_id, CASE WHEN count(*) > 1 THEN round((max(ts) - min(ts)) * 1000, 1) ELSE 0 END AS wall_ms, count(*) FILTER (kind = 'error') AS errors FROM {TRACE} GROUP BY turn_id")
def turn_header(spark, sf_dir):
    return _r(H.turn_header(trace(spark, sf_dir)), "wall_ms", places=1)


@query(f"SELECT turn_id, round(sum(coalesce(latency_ms, 0)), 6) AS latency_ms, round((max(ts) - min(ts)) * 1000, 1) AS wall_ms, count(*) FILTER (kind = 'error') AS errors FROM {TRACE} GROUP BY turn_id")
def turn_latency(spark, sf_dir):
    return _r(_r(H.turn_latency(trace(spark, sf_dir)), "latency_ms"), "wall_ms", places=1)


@query(f"SELECT turn_id, seq, latency_ms FROM {TRACE} WHERE kind = 'purchase'")
def events_of_kind(spark, sf_dir):
    return H.events_of_kind(trace(spark, sf_dir), "purchase").select("turn_id", "seq", "latency_ms")


@query(f"SELECT turn_id, bool_or(kind = 'error') AS has_errors FROM {TRACE} GROUP BY turn_id")
def has_errors(spark, sf_dir):
    return H.has_errors(trace(spark, sf_dir))


@query(f"SELECT turn_id, seq, '[' || seq || '] ' || kind || ' ' || substr(payload, 1, 120) AS line FROM {TRACE}")
def dump_lines(spark, sf_dir):
    return H.dump_lines(trace(spark, sf_dir))


@query(f"SELECT event_id, turn_id, seq FROM {TRACE}")
def assign_seq(spark, sf_dir):
    return trace(spark, sf_dir).select("event_id", "turn_id", "seq")


@query(f"SELECT turn_id, seq, kind FROM {TRACE}")
def append_events(spark, sf_dir):
    rows = trace(spark, sf_dir).select("turn_id", "seq", "kind")
    return H.append_events(rows.filter("seq % 2 = 0"), rows.unionByName(rows.filter("seq = 1")))


@query(f"SELECT round(avg(success::INT), 9) AS success_rate FROM {TURNS}")
def success_rate(spark, sf_dir):
    return _r(H.success_rate(turns(spark, sf_dir)), "success_rate", places=9)


_PLACED = "(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {v}) - 1 AS place, count(*) OVER (PARTITION BY {k}) AS n FROM {t} WHERE {v} IS NOT NULL)"


def _nearest(k, v, t):
    return f"SELECT {k}, max({v}) FILTER (place = least(floor(n * 0.5), n - 1)) AS p50, max({v}) FILTER (place = least(floor(n * 0.95), n - 1)) AS p95 FROM {_PLACED.format(k=k, v=v, t=t)} GROUP BY {k}"


@query(_nearest("l_returnflag, l_linestatus", "l_extendedprice", "lineitem"))
def percentile_nearest(spark, sf_dir):
    return H.percentile_nearest(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.5, 0.95], ["l_returnflag", "l_linestatus"])


@query("SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return _r(H.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"]), "mean", "p50", "p95", "p99")


@query(f"SELECT round(avg(cost_usd), 9) AS cost_per_task FROM {TURNS} WHERE capability = 'view'")
def cost_per_task(spark, sf_dir):
    return _r(H.cost_per_task(turns(spark, sf_dir), "view"), "cost_per_task", places=9)


@query(
    f"SELECT capability, n, success_rate, avg_cost_usd, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM (SELECT capability, count(*) AS n, round(avg(success::INT), 9) AS success_rate, round(avg(cost_usd), 9) AS avg_cost_usd FROM {TURNS} GROUP BY capability) LEFT JOIN ({_nearest('capability', 'latency_ms', TURNS)}) USING (capability)"
)
def eval_by_capability(spark, sf_dir):
    return _r(_r(H.eval_by_capability(turns(spark, sf_dir)), "success_rate", "avg_cost_usd", places=9), "p50", "p95")


@query(f"SELECT n, success_rate, avg_cost_usd, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM (SELECT count(*) AS n, round(avg(success::INT), 9) AS success_rate, round(avg(cost_usd), 9) AS avg_cost_usd FROM {TURNS}), ({_nearest('1', 'latency_ms', TURNS).replace('SELECT 1,', 'SELECT').replace(' GROUP BY 1', '')})")
def eval_summary(spark, sf_dir):
    return _r(_r(H.eval_summary(turns(spark, sf_dir)), "success_rate", "avg_cost_usd", places=9), "p50", "p95")


@query(
    f"SELECT user_id, kind, round(quantile_cont(latency_ms, 0.95), 6) AS p95, count(*) AS n FROM {TRACE} WHERE latency_ms IS NOT NULL AND turn_id IN (SELECT turn_id FROM {TRACE} GROUP BY turn_id HAVING max(ts) - min(ts) > 40000) GROUP BY user_id, kind"
)
def slow_trace_bottleneck(spark, sf_dir):
    return _r(H.slow_trace_bottleneck(trace(spark, sf_dir), 40000.0, "turn_id", "user_id"), "p95")


@query("SELECT event_id, 'payload.k' AS key, props->>'$.k' AS value FROM events")
def flatten_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", H.flatten_payload(F.col("props")).alias("m"))
    return rows.select("event_id", F.explode("m").alias("key", "value"))


@query(
    """WITH m AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, island::BIGINT AS island, count(*) AS failures FROM m WHERE NOT ok GROUP BY user_id, island HAVING count(*) >= 3"""
)
def failure_streaks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("success", F.col("event_type") != "error")
    return H.failure_streaks(rows, "user_id", ["ts", "event_id"]).select("user_id", "island", "failures")


@query("SELECT source AS topic, count(*) AS n FROM documents WHERE trim(regexp_extract(text, '(?i)license|rights', 0)) <> '' GROUP BY source")
def gap_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.regexp_extract("text", "(?i)license|rights", 0).alias("gaps"))
    return H.gap_report(rows)


@query(
    f"""SELECT o.turn_id, CASE WHEN c.outcome IS NULL THEN 'open' WHEN c.outcome = 'error' THEN 'failed' WHEN c.outcome = 'signup' THEN 'escalated' ELSE 'completed' END AS status, round(c.ts - o.ts, 3) AS seconds
    FROM (SELECT turn_id, min(ts) AS ts FROM {TRACE} GROUP BY turn_id) o LEFT JOIN (SELECT turn_id, max(ts) AS ts, arg_max(kind, seq) AS outcome FROM {TRACE} GROUP BY turn_id HAVING count(*) > 1) c USING (turn_id)"""
)
def turn_status(spark, sf_dir):
    t = trace(spark, sf_dir)
    opened = t.groupBy("turn_id").agg(F.min("ts").alias("ts"))
    closed = t.groupBy("turn_id").agg(F.max("ts").alias("ts"), F.max_by("kind", "seq").alias("outcome"), F.count("*").alias("n")).filter("n > 1")
    closed = closed.withColumn("outcome", F.when(F.col("outcome") == "signup", "escalated").otherwise(F.col("outcome")))
    return _r(H.turn_status(opened, closed), "seconds", places=3)
