"""Shared folder, written tables and sorted-group streaming for the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text at a time where each word becomes several numbers of features.
BATCH = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees; a temporary one where none is named and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, then_drop: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if then_drop:
        drop(spark, then_drop)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for table in tables:
        if path := source_of(table):
            drop(table.sparkSession, path)


def source_of(df: DataFrame) -> str:
    """Folder of a table that written() returned."""
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""


def quoted(name: str) -> str:
    """A column's name as one part, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def beside_text(df: DataFrame) -> Column:
    """All columns of df but text as one struct, so that columns added beside it can't clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns if c != "text"] or [F.lit(0).alias("_")])


def unpacked(columns: list[str], text: str = "text", rest: str = "rest") -> list[Column]:
    """The columns again, from a text column and the struct of the others."""
    return [F.col(text if c == "text" else f"{rest}.{quoted(c)}").alias(c) for c in columns]


def rows_where(docs: DataFrame, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns, whose text keep() marks in a list of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            yield batch.filter(pa.array(keep(batch.column("text").to_pylist())))

    rows = docs.select(F.col("text").cast("string").alias("text"), beside_text(docs).alias("rest"))
    return rows.mapInArrow(run, rows.schema).select(*unpacked(docs.columns))


def heavy_join(left: DataFrame, right: DataFrame, key: str, rows: str, share: int = 1000) -> DataFrame:
    """left joined with right, one row a key, whose column `rows` counts the rows of left with the key.

    Keys that hold more than one row in `share` are `share` at most and are broadcast, so that no task gathers one; the rest are merged.
    """
    least = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(rows) * share > least).drop(rows))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) * share <= least).drop(rows).hint("merge"), key)
    return left.join(hot, key).unionByName(rest)


def sorted_groups(batches: Iterator[pa.RecordBatch], same: Callable[[pa.Table], "list[int]"]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by group.

    same(table) gives the starts of its groups; the last group waits for the next batch,
    so memory is bounded by a batch and the longest group.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        cut = same(table)[-1]
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def small(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        at = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n) + 1
        yield batch.slice(at)


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store that holds uri and the path in it, from within a task."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")
