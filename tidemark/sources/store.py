"""Stages that queries share: tables kept for a state of their inputs and settings, bucketed where a key is named."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_folder, there

PREFIX = "tidemark_stage_"


def state(spark: SparkSession, paths: list[str]) -> str:
    """A mark of the files below paths, whatever their order: names, lengths and times of change. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, total = files.agg(F.count(F.lit(1)), F.sum(mark)).first()
    return f"{n}:{total}"


def _location(spark: SparkSession, table: str) -> str:
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()
    return found.data_type if found else ""


def _drop(spark: SparkSession, table: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(_location(spark, table))
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(spark: SparkSession, name: str, inputs: list[str], settings: dict, make: Callable[[], DataFrame], by: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """make()'s rows, written once for a name, a state of the input files and settings, and read by whoever asks for the same again.

    With `by` the table is bucketed by that column and sorted by it and `order`, one file a bucket, so that windows, groups and
    joins by it need no exchange. Its buckets are as many as shuffles have partitions, and part of what a stage is kept for.
    A table is named in the catalog once it is whole: a run that dies before leaves a folder that nothing reads.
    """
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if by else 0
    key = json.dumps([name, state(spark, inputs), settings, by, order, buckets], sort_keys=True, default=str)
    table = f"{PREFIX}{name}_{hashlib.sha256(key.encode()).hexdigest()[:20]}"
    if spark.catalog.tableExists(table):
        if there(spark, _location(spark, table)):
            return spark.table(table)
        spark.sql(f"DROP TABLE {table}")
    path = f"{shared_folder(spark)}/{table}-{uuid.uuid4().hex}"
    rows = make()
    out = rows.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, *order) if by else rows.write
    out.format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def stages(spark: SparkSession) -> list[str]:
    """Names of the stages that this session's catalog holds."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(PREFIX))


def drop_stages(spark: SparkSession, names: list[str] | None = None) -> None:
    """Drop these stages, or all, with their folders; frames that read them are of no more use."""
    for table in stages(spark) if names is None else names:
        _drop(spark, table)


@contextmanager
def kept(spark: SparkSession) -> Iterator[None]:
    """Stages made inside are shared inside and gone at the end, whether or not a query failed; earlier ones stay."""
    before = set(stages(spark))
    try:
        yield
    finally:
        drop_stages(spark, [t for t in stages(spark) if t not in before])
