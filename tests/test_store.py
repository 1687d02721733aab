"""The keyed store: what is rewritten, what a failed write leaves, and the same rows as a plain dictionary."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources.store import KeyedStore

SCHEMA = "k int, v string"


@pytest.fixture
def store(spark):
    return KeyedStore(spark, f"file://{tempfile.mkdtemp(prefix='spark-')}", SCHEMA, ["k"], parts=6)


def files(store):
    """Data files by partition of the last version."""
    root = store.path.removeprefix("file://")
    return {p: sorted(f for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet")) for p, d in store.manifest().items()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_touched_partitions_are_rewritten(spark, store):
    first = store.upsert(spark.createDataFrame([(i, "a") for i in range(60)], SCHEMA), [F.col("v")])
    before = files(store)
    second = store.upsert(spark.createDataFrame([(7, "b")], SCHEMA), [F.col("v")])
    after = files(store)
    assert (first, second) == (1, 2) and len(before) == len(after) == 6
    assert sum(before[p] != after[p] for p in before) == 1
    assert rows(store.read()) == sorted([(i, "b" if i == 7 else "a") for i in range(60)], key=str)
    assert rows(store.read(1)) == sorted([(i, "a") for i in range(60)], key=str)
    assert store.vacuum(keep=1) == 1 and rows(store.read()) == sorted([(i, "b" if i == 7 else "a") for i in range(60)], key=str)


def test_random_changes_match_a_dictionary(spark, store):
    rng, held, stamp = random.Random(4), {}, 0
    keys = [None, *range(25)]
    for _ in range(4):
        new = []
        for _ in range(rng.randint(0, 12)):
            stamp += 1
            new.append((rng.choice(keys), f"{stamp:04}"))
        gone = rng.sample(keys, 4)
        store.apply(spark.createDataFrame(new, SCHEMA), [F.desc("v")], spark.createDataFrame([(k,) for k in gone], "k int"))
        held = {k: v for k, v in held.items() if k not in gone} | dict(new)
        assert rows(store.read()) == sorted(held.items(), key=str)
    store.delete(spark.createDataFrame([(k,) for k in keys], "k int"))
    assert store.read().count() == 0 and store.manifest() == {}


def test_a_failed_write_leaves_the_version_before(spark, store):
    store.upsert(spark.createDataFrame([(i, "a") for i in range(20)], SCHEMA), [F.col("v")])
    broken = spark.createDataFrame([(3, "b")], SCHEMA).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        store.upsert(broken, [F.col("v")])
    assert store.version() == 1 and rows(store.read()) == sorted([(i, "a") for i in range(20)], key=str)
    # Data without a manifest, as from a writer that died before its end: the next version takes its place.
    root = store.path.removeprefix("file://")
    os.makedirs(f"{root}/data/2-dead/part_=0")
    os.makedirs(f"{root}/manifest/2")
    assert store.version() == 1
    os.rmdir(f"{root}/manifest/2")
    assert store.upsert(spark.createDataFrame([(3, "c")], SCHEMA), [F.col("v")]) == 2
    assert (3, "c") in rows(store.read())


def test_nothing_to_do_and_a_second_writer(spark, store):
    assert store.version() == 0 and store.read().count() == 0
    assert store.upsert(spark.createDataFrame([], SCHEMA), [F.col("v")]) == 0
    store.upsert(spark.createDataFrame([(1, "a")], SCHEMA), [F.col("v")])
    other = KeyedStore(spark, store.path, SCHEMA, ["k"], parts=6)
    other.version = lambda: 0  # has not seen the first version
    with pytest.raises(Exception, match="(?i)exists"):
        other.upsert(spark.createDataFrame([(2, "b")], SCHEMA), [F.col("v")])
    assert rows(store.read()) == [(1, "a")]
