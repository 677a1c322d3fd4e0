"""Corpus pipeline: quality filter, toxicity filter, near-duplicate removal, substring removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents.  run() writes each stage as Parquet to the shared folder and reads it for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, quality, substring, toxicity
from tidemark.llm._shared import unpacked, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps, with all their columns.

    Null, empty and blank texts score 0 and go. Null ids, repeated rows and ties are judged by their text alone, so equal texts
    have one fate. Texts of any length are read whole. An empty table gives an empty one. Columns of any name pass through.
    """
    return quality.kept_quality(docs, quality.fit(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't reject, with all their columns.

    Null and empty texts are never toxic and stay. Null ids stay or go by their text; they have no label. Repeated rows and equal
    texts have one fate. Texts of any length are read whole. An empty table gives an empty one. Columns of any name pass through.
    """
    return toxicity.kept_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five words, similarity 0.8.

    That of the smallest id stays, nulls last, among equal ids the first read. Rows are told apart by a number of their own, so ids may be
    null or repeated, and repeated rows leave one. Every row without words, its text null, empty or blank, is a group of its
    own and stays. Texts of any length are read whole. An empty table gives an empty one. Columns of any name pass through.
    """
    return minhash.deduplicated(docs, minhash.Near(words=5, percent=80))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 20 that occur earlier; other texts stay as they are.

    Earlier is by id, nulls first, then by the text's digest and the place. Null texts stay null. Rows that repeat id and text count as one
    document, so each gets the same text. Texts of any length are read whole; n_chars follows a changed text. An empty table gives
    an empty one. Columns of any name pass through.
    """
    out = substring.repeats_removed(docs, window=20, carry=[c for c in docs.columns if c != "text"])
    changed = F.col("n_removed") > 0
    own = dict(zip(docs.columns, unpacked(docs.columns)))
    own["text"] = F.when(changed, F.col("kept")).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return out.select(*[column.alias(name) for name, column in own.items()])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens.

    Null and empty texts are one piece of the closing id. Null ids are kept, repeated rows are packed each, and ties go by the order of
    rows. Texts of any length are encoded whole. An empty table gives an empty one. Other columns are left out.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end=0)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring", substring_stage),
    ("packing", packing_stage),
]

#: Trained models and token ids aren't expressible in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
