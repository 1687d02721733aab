"""A table keyed by columns, whose rows are dealt into partitions by key: a change rewrites those partitions only that it touches.

Every version has a manifest, a small table written by Spark that names the folder of each partition. Folders are never
written twice. A version counts from the moment that its manifest is complete, so that a write that fails leaves the
version before as it was, and readers see one version or the next; a second writer of the same version fails, and its
folder is named by no manifest.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.registry import latest
from tessera.session import join_checked, materialise

_ENTRY = "part int, folder string"
_PART = "part_"


class KeyedStore:
    """The store at ``path``, of rows with ``schema``, keyed by ``key`` and dealt into ``parts`` partitions, fixed for good."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], parts: int = 64) -> None:
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(context._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last complete version; 0 before the first."""
        at, fs = self._fs(f"{self.path}/manifest/*/_SUCCESS")
        return max([int(s.getPath().getParent().getName()) for s in fs.globStatus(at) or []], default=0)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each partition that has rows; at most one for each partition."""
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.schema(_ENTRY).json(f"{self.path}/manifest/{version}").collect()
        return {r.part: r.folder for r in rows}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        return self._rows(list(self.manifest(version).values()))

    def _part(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def upsert(self, updates: DataFrame, order: list) -> int:
        """Write ``updates`` over the rows of their keys, the first in ``order`` of each key; the new version's number."""
        return self.apply(updates, order)

    def delete(self, keys: DataFrame) -> int:
        """Take the rows of ``keys`` out; the new version's number."""
        return self.apply(None, [], keys)

    def apply(self, updates: DataFrame | None, order: list, gone: DataFrame | None = None) -> int:
        """Updates and deletions as one version; a key that is in both is written. Nulls in keys are equal to one another.

        Without a change there is no new version.
        """
        version = self.version()
        sides = [gone.select(*self.key).distinct().withColumn("live_", F.lit(False))] if gone is not None else []
        new = None
        if updates is not None:
            new = materialise(latest(updates, self.key, order).select(*self.schema.names), "updates")
            sides.append(new.select(*self.key).withColumn("live_", F.lit(True)))
        changed = materialise(reduce(DataFrame.unionByName, sides).select(*self.key, self._part().alias(_PART)).distinct(), "changed")
        touched = sorted(r[0] for r in changed.select(_PART).distinct().collect())  # as many as there are partitions, at most
        if not touched:
            return version
        held = self.manifest(version)
        old = self._rows([held[p] for p in touched if p in held])
        names = {k: f"{k}_changed" for k in self.key}
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        kept = join_checked(old, changed.drop(_PART).withColumnsRenamed(names), same, "left_anti")
        rows = kept if new is None else kept.unionByName(new)
        folder = f"data/{version + 1}-{uuid.uuid4().hex}"
        # Ranges of (partition, key): a task writes few partitions, and a large partition is written by several tasks.
        dealt = rows.withColumn(_PART, self._part()).repartitionByRange(_PART, *self.key)
        dealt.write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        written = {r[0] for r in self.spark.read.schema(f"{_PART} int").parquet(f"{self.path}/{folder}").select(_PART).distinct().collect()}
        entries = {p: f for p, f in held.items() if p not in touched} | {p: f"{folder}/{_PART}={p}" for p in written}
        self.spark.createDataFrame(sorted(entries.items()), _ENTRY).coalesce(1).write.json(f"{self.path}/manifest/{version + 1}")
        return version + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` versions names, and older manifests; how many folders went."""
        last = self.version()
        live = {f for v in range(max(1, last - keep + 1), last + 1) for f in self.manifest(v).values()}
        at, fs = self._fs(f"{self.path}/data/*/{_PART}=*")
        gone = 0
        for status in fs.globStatus(at) or []:
            path = status.getPath()
            if f"data/{path.getParent().getName()}/{path.getName()}" not in live and int(path.getParent().getName().split("-")[0]) <= last:
                gone += fs.delete(path, True)
        for v in range(1, last - keep + 1):
            at, fs = self._fs(f"{self.path}/manifest/{v}")
            fs.delete(at, True)
        return gone
