"""Production runs of the ten operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import oracle

RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeats_removed

    out = repeats_removed(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spots import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), capacity=2048, end=0)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, scored

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, fit(docs))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import Near, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), Near(words=4, percent=80))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), least=0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, scored

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import token_counts

    out = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .align import aligned

    rows, _ = aligned(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, public_tokenizers.path(PIECES))
    return rows.select(*[c for c in rows.columns if c != "groups"], F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import described, periodic_runs, planted

    return described(periodic_runs(_table(spark, sf_dir, "documents"), least=6, times=4, change=planted))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents")).drop("places")


QUERIES = {f.__name__: f for f in (op1_topk, op2_substring, op3_fingerprints, op4_packing, op5_bpe, op6_quality, op7_minhash, op8_warc, op9_toxicity, op10_tokens, op11_alignment, op12_runs, op13_licenses)}

ORACLE = {
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op2_substring": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS s, w FROM d WHERE len(w) >= 20),
     h AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS k FROM g),
     e AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM h),
     c AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS i FROM e WHERE n > 1),
     p AS (SELECT d.doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d) d),
     k AS (SELECT p.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p.i) AS t FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op13_licenses": oracle(),
}
