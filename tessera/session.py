"""Session helpers: a local session for tests, and tables written to the shared folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this machine's only with a local master."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(df: DataFrame) -> None:
    """Delete the table that :func:`materialise` wrote for ``df``, of which nothing is read any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", max_rows: int = 200_000) -> DataFrame:
    """Join with ``right`` broadcast if it has at most ``max_rows`` rows (counted), else by shuffle.

    ``right`` should be a materialised table of narrow rows, so that the count is cheap and the bound on
    rows bounds the bytes.
    """
    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right, on, how)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    digest = hashlib.sha256(context.applicationId.encode()).hexdigest()[:12]
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"tessera-{digest}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("tessera", os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
