"""Runs a query beside its SQL and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if hasattr(value, "asDict"):
        return str({k: plain(v) for k, v in value.asDict().items()})
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def compare(spark, con, query, sql, sf_dir):
    """None if alike, else what differs."""
    df = query(spark, sf_dir)
    got_names = sorted(df.columns)
    rows = con.execute(sql)
    names = [d[0] for d in rows.description]
    if sorted(names) != got_names:
        return f"columns {got_names} and {sorted(names)}"
    place = [names.index(n) for n in got_names]
    want = sorted(tuple(plain(r[i]) for i in place) for r in rows.fetchall())
    got = sorted(tuple(plain(r[n]) for n in got_names) for r in df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; e.g. {[x for x in got if x not in set(want)][:1]} and {[x for x in want if x not in set(got)][:1]}"[:900]
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, {got_names}: {bad[0]}"[:900] if bad else None
