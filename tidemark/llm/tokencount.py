"""Token counts by a separator scan of flat token files.

Flat files hold the 16-bit ids of one document after the other, each closed by the end-of-document id, and no
index.  Files are read in blocks; each block is searched for the separator at once with numpy.  A prefix
scan over the blocks of a file stitches them: the separators before a block number its documents, and the last
one before it begins the document that the block ends.

Null and empty texts are a separator alone, 0 tokens.  Rows may repeat; null ids are kept; extra columns are ignored.
Texts of any length are encoded whole; one document may span many blocks. Tokens after the last separator of a file belong
to no document and are not counted. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._encode import encoder
from ._shared import file_system, new_path, small, written

END = 50256
BLOCK = 1 << 20


def _write(folder: str, ranks_path: str, pattern: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.bin"  # each attempt has its own file; only those in the table that it commits are read
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        nth = size = 0
        with store.open_output_stream(f"{path}/{name}", compression=None) as stream:
            for batch in small(batches, "text"):
                for text in batch.column("text").to_pylist():
                    data = np.array([*encode(text or ""), end], dtype="<u2").tobytes()
                    stream.write(data)
                    size += len(data)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name] * n), pa.array(np.arange(nth, nth + n)), pa.array(np.full(n, size))], names=["doc_id", "file", "nth", "size"])
                nth += n

    return run


def write_flat(docs: DataFrame, folder: str, ranks_path: str, pattern: str, end: int = END) -> DataFrame:
    """Write flat token files to folder; returns where each document went, (doc_id, file, nth), and bytes written so far."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(_write(folder, ranks_path, pattern, end), "doc_id long, file string, nth long, size long"), "flat-order")


def _scan(folder: str, block: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist()):
                with store.open_input_file(f"{root}/{file}") as source:
                    data = np.frombuffer(source.read_at(2 * block, 2 * at), dtype="<u2")
                found = np.flatnonzero(data == end) + at
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["file", "at", "found"])

    return run


def separator_counts(files: DataFrame, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, nth, start, n_tokens) of each document of the flat files (file, size in bytes)."""
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(2 * block).cast("long"))).alias("at")).select("file", (F.col("at") / 2).cast("long").alias("at"))
    found = blocks.repartition("file", "at").mapInArrow(_scan(folder, block, end), "file string, at long, found array<long>")
    past = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumns({"nth": F.coalesce(F.sum(F.size("found")).over(past), F.lit(0)), "last": F.coalesce(F.max(F.array_max("found")).over(past), F.lit(-1))})
    ends = found.select("file", "nth", "last", "found", F.posexplode("found").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("last")).otherwise(F.get("found", F.col("k") - 1)) + 1
    return ends.select("file", (F.col("nth") + F.col("k")).alias("nth"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(doc_id, file, nth, start, n_tokens) of every row of docs, counted in flat files written from them."""
    folder = new_path(docs.sparkSession, "flat")
    order = write_flat(docs, folder, ranks_path, pattern, end)
    files = order.groupBy("file").agg(F.max("size").alias("size"))
    return order.select("doc_id", "file", "nth").join(separator_counts(files, folder, end, block).hint("merge"), ["file", "nth"]).select("doc_id", "file", "nth", "start", "n_tokens")
