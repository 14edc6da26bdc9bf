"""Token counts of documents in flat token files that have no index.

A file is a run of little-endian unsigned integers in which a separator closes each document. Files are read in
blocks by offset; a vectorised search finds the separators of a block, and a prefix scan over the blocks' summaries
(tokens, separators and the last separator) gives each document its number and the place where it began, however
many blocks it spans. Blocks are independent, so a file of any size is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .packing import encoder

WIDTHS = {2: "<u2", 4: "<u4"}
MANIFEST = "file string, doc_number long, doc_id long"


def write_token_files(spark: SparkSession, docs: DataFrame, where: str, path: str, pattern: str, separator: int, width: int = 2) -> DataFrame:
    """Writes each partition's token files under ``where`` and returns ``file, doc_number, doc_id`` in order.

    A document is its whole text's ids (null or empty: none; the strings of special tokens are ordinary text, so that
    no text yields the separator), then the separator. A task writes
    to a name of its own attempt and renames at its end, so a repeated task replaces its file whole.
    """
    if width not in WIDTHS or separator >= 1 << (8 * width):
        raise ValueError("width must be 2 or 4 bytes and hold the separator")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = encoder(path, pattern), TaskContext.get()
        system, folder = fs.FileSystem.from_uri(where)
        name = f"part-{task.partitionId():06d}.tokens"
        own = f"{folder}/.{name}.{task.taskAttemptId()}"
        number, manifest = 0, []
        with system.open_output_stream(own) as out:
            for batch in batches:
                ids, bounds = cache.batch(batch.column(1).to_pylist())
                out.write(np.insert(ids, bounds[1:], separator).astype(WIDTHS[width]).tobytes())
                n = batch.num_rows
                manifest.append(pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(np.arange(number, number + n)), batch.column(0)], ["file", "doc_number", "doc_id"]))
                number += n
        system.move(own, f"{folder}/{name}")
        yield from manifest

    system, folder = fs.FileSystem.from_uri(where)
    system.create_dir(folder, recursive=True)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MANIFEST)


def count_tokens(spark: SparkSession, where: str, separator: int, width: int = 2, block_bytes: int = 1 << 27) -> DataFrame:
    """``file, doc_number, start, n_tokens`` of every document of the ``*.tokens`` files under ``where``.

    doc_number counts from 0 in each file, start is its first token, and n_tokens leaves the separator out. Tokens
    after a file's last separator are a document too; an empty file has none, and two separators in a row close a
    document of no tokens. A file whose size is no multiple of ``width`` fails.
    """
    if block_bytes % width:
        raise ValueError("block_bytes must be a multiple of width")
    kind = WIDTHS[width]
    system, folder = fs.FileSystem.from_uri(where)
    sizes = [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".tokens")]
    files = spark.createDataFrame(sizes, "file string, bytes long")
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    # about a block of bytes to a task, and a block at once in it; small files share tasks
    spread = max(spark.sparkContext.defaultParallelism, -(-sum(n for _, n in sizes) // block_bytes))
    blocks = blocks.repartition(spread, "file", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(where)
        for batch in batches:
            for file, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size % width:
                    raise ValueError(f"{file}: {size} bytes")
                with system.open_input_file(file) as f:
                    tokens = np.frombuffer(f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), kind)
                at = np.flatnonzero(tokens == separator) + block * (block_bytes // width)
                ends = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at, pa.int64()))
                end = (block * block_bytes) // width + len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([end]), pa.array([end * width == size]), ends], ["file", "block", "end", "final", "ends"])

    found = Scratch(spark, "token-scan").put(blocks.mapInArrow(scan, "file string, block long, end long, final boolean, ends array<long>"), "ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the prefix scan carries two numbers for each block, documents closed before it and where the open one began; only they
    # are shuffled by file, and positions stay where they are until then
    thin = found.select("file", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    carried = thin.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("closed"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("began"))
    scanned = found.join(carried, ["file", "block"])
    last = F.coalesce(F.array_max("ends") + 1, F.col("began"))
    ends = F.when(F.col("final") & (last < F.col("end")), F.concat("ends", F.array("end"))).otherwise(F.col("ends"))
    starts = F.concat(F.array("began"), F.transform("ends", lambda x: x + 1))
    each = scanned.select("file", "closed", F.posexplode(F.arrays_zip(ends.alias("end"), F.slice(starts, F.lit(1), F.size(ends)).alias("start"))).alias("i", "d"))
    return each.select("file", (F.col("closed") + F.col("i")).alias("doc_number"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"))


def document_tokens(spark: SparkSession, docs: DataFrame, path: str, pattern: str, separator: int, width: int = 2) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs``, by writing flat token files and scanning them.

    Null and empty texts have 0 tokens; repeated rows and null doc_ids are counted one by one; columns other than
    doc_id and text are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "token-counts")
    where = scratch.path("files")
    manifest = scratch.put(write_token_files(spark, docs, where, path, pattern, separator, width), "manifest")
    counted = scratch.put(count_tokens(spark, where, separator, width), "counts")
    scratch.delete(where)
    return manifest.join(counted, ["file", "doc_number"]).select("doc_id", "n_tokens")
