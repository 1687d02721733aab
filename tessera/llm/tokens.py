"""Token counts by separator scan.

Token files are flat: 16-bit little-endian ids, an end-of-document id after each document, no index. A scan cuts
the files into blocks of equal size, each block is searched for separators in one vector operation, and what
lies across blocks is stitched by a prefix scan over one narrow row for each block.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.memory import map_batches
from tessera.session import materialise, shared_path

#: Rank file of a public byte-level tokenizer, its end-of-document id, and the fixed split pattern that belongs to it.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_OF_DOCUMENT = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that the pattern takes for white space.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of so many white-space characters are found here; the pattern's search for their end goes as deep as they are long.
LONG_RUN = 1024
#: Bytes of a block.
BLOCK_BYTES = 8 << 20


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_LONG_RUN = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")


def encode(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """The token ids of a text, as ``encode_ordinary`` gives them.

    A long run of white space is one piece by the pattern, but for its last character where another follows, which
    starts the next piece. Such a piece is encoded as it is, so that no search goes deep.
    """
    out, at = [], 0
    for run in _LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += [encoding.encode_ordinary(text[at : run.start()]), encoding._encode_single_piece(text[run.start() : stop])]
        at = stop
    out.append(encoding.encode_ordinary(text[at:]))
    return np.concatenate([np.array(ids, "<u2") for ids in out])


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """Write one flat token file for each task, and return the materialised manifest ``(file, ordinal, doc_id)``.

    Every attempt of a task writes a file of its own name; the manifest, written by Spark, names those of
    attempts that were committed, so a repeated or lost attempt does no harm. Null texts are empty documents.
    The tokenizer file, of fixed size, is sent to the executors.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, ordinal = _encoding(SparkFiles.get(os.path.basename(tokenizer))), 0
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    for text in part.column(1):
                        out.write(np.append(encode(encoding, text.as_py() or ""), np.uint16(separator)).astype("<u2").tobytes())
                    places = pa.array(range(ordinal, ordinal + part.num_rows), pa.int64())
                    ordinal += part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), places, part.column(0)], names=["file", "ordinal", "doc_id"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(map_batches(rows, run, "file string, ordinal long, doc_id long"), "manifest")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, file, bytes)`` of the token files of a folder; the contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return listed.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def scan_token_files(files: DataFrame, separator: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, ordinal, start, n_tokens, ended)``: every document of the files ``(path, file, bytes)``.

    start and n_tokens are in tokens and without the separator. Tokens after the last separator are a document
    that has not ended; an empty file has none. A byte that is left over at the end is not read.
    """
    step = block_bytes // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _file_system(row["path"])
                with system.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(2 * row["n"], 2 * row["start"]), "<u2")
                ends = np.flatnonzero(ids == separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([row["start"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends.astype(np.int64)], pa.list_(pa.int64()))],
                    names=["file", "block", "block_start", "n", "ends"],
                )

    total = F.floor(F.col("bytes") / 2).cast("long")
    blocks = files.filter("bytes >= 2").select("path", "file", total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(step).cast("long"))).alias("start"))
    blocks = blocks.select("path", "file", F.floor(F.col("start") / step).alias("block"), "start", F.least(F.lit(step).cast("long"), F.col("total") - F.col("start")).alias("n"))
    found = materialise(map_batches(blocks.repartition("file", "block"), run, "file string, block long, block_start long, n long, ends array<long>"), "blocks")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    has = F.size("ends") > 0
    open_tokens = F.when(has, F.col("n") - 1 - F.element_at("ends", -1)).otherwise(F.col("n"))
    marks = found.select(
        "file", "block", "block_start", "n", "ends", open_tokens.alias("open"),
        F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.sum(has.cast("long")).over(before), F.lit(0)).alias("run"),
        F.lead("block").over(order).isNull().alias("last"),
    )
    in_run = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # A run is the blocks after one with separators up to the next such; it starts with that one's open tokens.
    opened = F.sum(F.when(~has, F.col("n")).otherwise(F.lit(0))).over(in_run)
    previous = F.coalesce(F.last(F.when(has, F.col("open")), ignorenulls=True).over(before), F.lit(0))
    marks = marks.withColumn("carry", previous + F.coalesce(opened, F.lit(0)))
    ended = marks.select("file", "block_start", "ordinal", "carry", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, -F.col("carry")).otherwise(F.get("ends", F.col("k") - 1) + 1)
    ended = ended.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), (F.col("block_start") + start).alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    left = F.when(F.size("ends") > 0, F.col("open")).otherwise(F.col("carry") + F.col("n"))
    rest = marks.filter("last").select("file", (F.col("ordinal") + F.size("ends")).alias("ordinal"), (F.col("block_start") + F.col("n") - left).alias("start"), left.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest.filter("n_tokens > 0"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens)`` row for row: the documents are written as flat token files, which are scanned.

    Null and empty texts have no tokens; null ids and repeated rows are returned as they come; an empty table
    gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    manifest = write_token_files(docs, folder, id_col, text_col, tokenizer)
    if manifest.isEmpty():
        return manifest.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    committed = token_files(spark, folder).join(manifest.select("file").distinct(), "file", "left_semi")
    found = scan_token_files(committed, END_OF_DOCUMENT, block_bytes)
    return manifest.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
