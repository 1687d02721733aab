"""The pipeline stage by stage on the smallest tables, each stage held against a plain form on what it was given."""

import re

import duckdb
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import mixing
from tessera.session import materialise
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows given, rows returned) of each stage."""
    from tessera.session import ship

    ship(spark)
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, materialise(stage(spark, docs, SF_DIR), name)
        out[name] = given.collect(), docs.collect()
    return out


def test_language_id_drops_what_has_no_letter(stages):
    given, kept = stages["language_id"]
    assert sorted(kept) == sorted(r for r in given if r.text is not None and any(c.isalpha() for c in r.text))


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_dedup_keeps_the_least_of_each_component(stages):
    given, kept = stages["simhash_near_dedup"]
    prints, root = [fingerprint(r.text) for r in given], list(range(len(given)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, r in enumerate(given):
        groups.setdefault(top(i), []).append(r)
    assert sorted(r.doc_id for r in kept) == sorted(min(r.doc_id for r in g) for g in groups.values())
    assert set(kept) <= set(given) and len(kept) < len(given)


def test_decontamination_drops_what_holds_an_item_and_keeps_what_shares_no_window(spark, stages):
    given, kept = stages["benchmark_decontamination"]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    windows = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    # Numbers, units and names are replaced by kinds, so that a window of any of them is none in particular.
    plain = lambda s: {x for x in s if not any(c.isdigit() for w in x for c in w)}
    items = [words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    asked = set().union(*[windows(w) for w in items])
    left = {r.doc_id for r in kept}
    for r in given:
        own = words(r.text)
        if any(" ".join(w) in " ".join(own) for w in items):
            assert r.doc_id not in left
        elif r.doc_id not in left:  # only for an item, of which it shares most windows
            assert plain(windows(own)) & asked or any(c.isupper() for c in r.text)
        if not {w for x in windows(own) for w in x} & {w for x in items for w in x}:
            assert r.doc_id in left
    assert 0 < len(given) - len(kept) < 0.2 * len(given) and set(kept) <= set(given)


def test_secrets_are_masked_and_all_else_stays(stages):
    given, kept = stages["secret_scan"]
    rules = [r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}", r"AKIA[A-Z0-9]{12,}", r"(?<![0-9a-f])[0-9a-f]{32,}"]
    before = {r.doc_id: r for r in given}
    assert len(kept) == len(given)
    masked = 0
    for r in kept:
        old = before[r.doc_id]
        assert (r.lang, r.source) == (old.lang, old.source) and r.n_chars == len(r.text)
        masked += r.text != old.text
        assert not any(re.search(p, r.text) for p in rules), r.doc_id
    assert sum(any(re.search(p, r.text) for p in rules) for r in given) <= masked < 0.5 * len(kept)


def test_mix_is_the_sql_of_its_rows(spark, stages):
    given, mixed = stages["mix_sources"]
    con = duckdb.connect()
    con.execute("CREATE TABLE given (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in given])
    rows = con.execute(mixing.MIX_SQL.replace("{docs}", "given"))
    names = [d[0] for d in rows.description]
    want = sorted(tuple(oracle.plain(v) for v in r) for r in rows.fetchall())
    assert sorted(tuple(oracle.plain(r[n]) for n in names) for r in mixed) == want
