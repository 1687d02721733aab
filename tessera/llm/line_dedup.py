"""Line dedup by levelled sorted runs of line hashes, with DataFrame functions only.

What is known of lines lies in runs: tables of ``(h1, h2, n, keeper)``, a row for each key with the number of its
documents and the largest id among them, bucketed and sorted by hash, so that two runs, or a batch and a run, meet
bucket by bucket in a merge join without a shuffle. A batch of documents is brought to the same form, anti-joined with
every run that has settled its keys already (enough documents, no larger id to come), and what is left is its own run
of level 0. As soon as a level has so many runs they are compacted into one of the next, counts summed.

The documents are then met with the keys of all runs together that enough documents hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chars import ascii_lower, stripped
from tessera.llm.memory import others
from tessera.session import discard, join_checked, materialise, shared_path

#: Code points that a key has at least, and documents that hold it, for its lines to go.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches of a first load; runs of a level that are compacted into one of the next.
BATCHES, FAN_IN = 8, 4
#: Lost lines that are broadcast at most; more meet their documents by a shuffle.
BROADCAST_LINES = 1_000_000

_HASH = ("h1", "h2")
_RUN_COLUMNS = ("h1", "h2", "n", "keeper")
_RUN_SCHEMA = "h1 long, h2 long, n long, keeper long"


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(doc_id, text_key, pos, h1, h2)`` for each line whose key is long enough; pos counts from 0.

    A key's 128 bits of hash stand for it. ``text_key`` tells rows of one id with unlike texts apart.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    long = slim.filter(F.char_length("line") >= least_chars).withColumn("line", stripped(F.col("line")))
    keys = long.filter(F.char_length("line") >= least_chars).withColumn("line", ascii_lower(F.col("line")))
    return keys.select("doc_id", "text_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def counted(lines: DataFrame) -> DataFrame:
    """``(h1, h2, n, keeper)``: the documents of each key, a null id being one document less than all others, and the largest id."""
    held = lines.groupBy(*_HASH, "doc_id").agg(F.lit(1).alias("one"))  # a key that very many documents hold is spread by id
    return held.groupBy(*_HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))


class LineRuns:
    """Levelled sorted runs. A document's lines are added in one batch; batches may come in any order, at best with falling ids."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, least_docs: int = LEAST_DOCS, fan_in: int = FAN_IN) -> None:
        self.spark = spark
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.least_docs, self.fan_in = least_docs, fan_in
        self.levels: list[list[str]] = []
        self._folder = shared_path(spark, "runs")

    def _path(self, name: str) -> str:
        return f"{self._folder}/{name}"

    def _write(self, dealt: DataFrame) -> str:
        """``dealt``, whose partitions are its buckets, as a sorted run."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt.select(*_RUN_COLUMNS).write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", self._path(name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        run = self.spark.table(name)
        run.stored_at = self._path(name)
        self.spark.sql(f"DROP TABLE {name}")
        discard(run)

    def names(self) -> list[str]:
        """The runs, lowest level first."""
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Anti-join a batch of :func:`keyed_lines` with the runs, keep the rest as a run, compact full levels."""
        batch = counted(lines).repartition(self.buckets, *_HASH)
        for name in self.names():
            settled = self.spark.table(name).filter(F.col("n") >= self.least_docs).select(*_HASH, F.col("keeper").alias("last")).hint("merge")
            known = (batch["h1"] == settled["h1"]) & (batch["h2"] == settled["h2"]) & F.coalesce(batch["keeper"] <= settled["last"], F.lit(True))
            batch = batch.join(settled, known, "left_anti")
        self._level(0).append(self._write(batch))
        self._compact()

    def _level(self, number: int) -> list[str]:
        while len(self.levels) <= number:
            self.levels.append([])
        return self.levels[number]

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as files: a union of bucketed tables would be taken for bucketed by the planner, but not be read so.
        rows = self.spark.read.schema(_RUN_SCHEMA).parquet(*[self._path(n) for n in names])
        return rows.repartition(self.buckets, *_HASH).groupBy(*_HASH).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def _compact(self) -> None:
        number = 0
        while number < len(self.levels):
            if len(self.levels[number]) >= self.fan_in:
                full, self.levels[number] = self.levels[number], []
                self._level(number + 1).append(self._write(self._merged(full)))
                for name in full:
                    self._drop(name)
            number += 1

    def frequent(self) -> DataFrame:
        """``(h1, h2, n, keeper)`` of keys that enough documents hold; n is exact below the limit and a lower bound from there on."""
        if not self.names():
            return self.spark.createDataFrame([], _RUN_SCHEMA)
        return self._merged(self.names()).filter(F.col("n") >= self.least_docs)

    def close(self) -> None:
        """Delete all runs."""
        for name in self.names():
            self._drop(name)
        self.levels = []


def _batch(docs: DataFrame, batches: int) -> Column:
    """The batch of a ``doc_id``: ranges of ids about as full as one another, the largest ids first, null ids last."""
    at = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 10_000).alias("cuts")).first().cuts if at else None
    batch = F.lit(batches - 1)
    for below, cut in enumerate(cuts or []):
        batch = F.when(F.col("doc_id") > cut, batches - 2 - below).otherwise(batch)
    return batch


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """``(doc_id, text_key, dropped)``: the places of the lines that a row loses; rows that lose none are left out."""
    spark = docs.sparkSession
    batch = _batch(docs.select(F.col(id_col).cast("long").alias("doc_id")), batches)
    batched = keyed_lines(docs, id_col, text_col, least_chars).withColumn("batch", batch)
    path = shared_path(spark, "lines")
    batched.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(batched.schema).parquet(path)
    lines.stored_at = path
    runs = LineRuns(spark, least_docs=least_docs)
    for number in range(batches):
        runs.add(lines.filter(F.col("batch") == number))
    frequent = materialise(runs.frequent().select(*_HASH, "keeper"), "frequent")
    runs.close()
    lost = join_checked(lines, frequent, list(_HASH)).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    out = materialise(lost.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("dropped")), "dropped")
    discard(lines)
    discard(frequent)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``; all columns and rows stay.

    A line's key is the line without white space at both ends and with A-Z in lower case. Keys of ``least_chars`` code
    points or more that ``least_docs`` documents hold lose all their lines but those of the document of the largest id.
    Rows of one id are one document; rows without an id are one document, less than all others. A null or empty text is
    one empty line. Columns of ``docs`` that have the names of new ones go.
    """
    lost = dropped_lines(docs, id_col, text_col, least_chars, least_docs, batches)
    size = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("dropped")), F.lit(0)).alias("lines")).first()
    lost = lost.withColumnsRenamed({"doc_id": "lost_id_", "text_key": "lost_key_", "dropped": "lost_"})
    lost = F.broadcast(lost) if size.n + size.lines <= BROADCAST_LINES else lost
    rows = docs.select(*[F.col(f"`{c}`") for c in others(docs.columns, ["kept_text", "n_lines", "n_dropped"])])
    met = rows.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col("lost_id_")) & (F.xxhash64(F.col(text_col)) == F.col("lost_key_")), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    met = met.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size("lost_"), F.lit(0)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost_"))
    text = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return met.withColumn("kept_text", F.when(F.col("n_dropped") == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(text)).drop("lost_id_", "lost_key_", "lost_")


#: The digest of the same in SQL.
DEDUP_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}),
p AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM p),
f AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
