"""Document fingerprints from spot signatures, with DataFrame functions alone.

Common words are anchors.  An anchor with the chain of the next two content words, other anchors
skipped, is a signature; the fingerprint is the set of its signatures' 32-bit hashes, written as
sorted hexadecimal numbers.  A text without any signature is described by its words instead, so every
text with a word has a fingerprint.

Words are lower-cased runs of letters and digits. Null and blank texts have the empty fingerprint; two
empty ones have likeness 1. Likeness is the Jaccard index of the sets.

The next document is found without a global sort: ids are cut into blocks at quantiles, and the first
document of each block also visits the block before.  Rows that repeat an id are ordered by the hash of
their text, by which many rows of one id are cut into blocks too; null ids come first. A table of one row is its own next.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import heavy_join, written

# Common words of four languages.
ANCHORS = sorted(set(
    "the of and to in is was it for on are as with be by this that at or an a from "
    "der die und das von zu mit den des ist ein eine für nicht auf sich dem im auch es "
    "le la les de un une en du que est pour dans qui par sur pas au plus et "
    "el los las y del se no por con su para una al lo como".split()
))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the sorted distinct signature hashes of a text column."""
    anchor = lambda x: x.isin(ANCHORS)
    df = df.withColumn("_w", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    df = df.withColumn("_a", F.array_compact(F.transform("_w", lambda x, i: F.when(anchor(x), i))))
    df = df.withColumn("_c", F.filter("_w", lambda x: ~anchor(x)))
    df = df.withColumn("_s", F.array_compact(F.transform("_a", lambda i, j: F.when(i - j + 1 < F.size("_c"), F.hash(F.get("_w", i), F.get("_c", i - j), F.get("_c", i - j + 1))))))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.transform("_w", lambda x: F.hash(x))))))
    return df.drop("_w", "_a", "_c", "_s")


def as_text(signatures: str):
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.right(F.concat(F.lit("0000000"), F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(8)))), "")


def likeness(a: str, b: str):
    """Jaccard index, pruned to 0 where one set is empty and to 1 where they are equal."""
    both = F.size(F.array_intersect(a, b))
    bound = F.least(F.size(a), F.size(b))
    return F.when(F.col(a) == F.col(b), 1.0).when(bound == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def next_document(docs: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, text, mark, block, guest), blocks being a number of about equal ranges of ids; an id, or null, with many rows is cut by their marks.

    The first row of each block is also a guest of the block before, the very first one of the last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    found = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 100 * blocks).alias("cuts"), F.avg(F.col("doc_id").isNull().cast("double")).alias("nulls")).first()
    shares = lambda m: [-(1 << 63) + j * ((1 << 64) // m) for j in range(m)]
    borders = [(None, x) for x in shares(max(1, math.ceil((found.nulls or 0.0) * blocks)))[1:]] + [(-(1 << 63), -(1 << 63))]
    borders += [(v, x) for v, m in sorted(Counter(found.cuts or []).items()) for x in shares(m)]
    place = F.struct("doc_id", "mark")
    listed = F.array(*[F.struct(F.lit(v).cast("long").alias("doc_id"), F.lit(x).cast("long").alias("mark")) for v, x in borders])
    docs = docs.withColumn("block", F.size(F.filter(listed, lambda b: b <= place)))
    firsts = sorted((r.block, tuple(r["first"])) for r in docs.groupBy("block").agg(F.min(place).alias("first")).collect())  # one place for each block
    numbers = {b: i for i, (b, _) in enumerate(firsts)}
    first = F.create_map(*[x for b, (v, m) in firsts for x in (F.lit(b), F.struct(F.lit(v).cast("long").alias("doc_id"), F.lit(m).cast("long").alias("mark")))]) if firsts else F.lit(None)
    back = F.create_map(*[x for b, i in numbers.items() for x in (F.lit(b), F.lit(firsts[i - 1][0]))]) if firsts else F.lit(None)
    own = F.struct("block", F.lit(0).alias("guest"))
    if firsts:
        visit = F.struct(F.element_at(back, F.col("block")).alias("block"), F.lit(1).alias("guest"))
        places = F.when(F.element_at(first, F.col("block")).eqNullSafe(place), F.array(own, visit)).otherwise(F.array(own))
    else:
        places = F.array(own)
    return docs.select("doc_id", "text", "mark", F.explode(places).alias("at")).select("at.*", "doc_id", "text", "mark").repartition("block")


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures) for every row of docs."""
    blocks = blocks or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_signatures(next_document(docs, blocks), "text", "own")
    order = W.partitionBy("block").orderBy("guest", F.asc_nulls_first("doc_id"), "mark")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next": F.lead("own").over(order)}).where("guest = 0")
    half = F.expr("length(text) div 2").cast("int")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.concat(F.expr("left(text, length(text) - int(length(text) div 2))"), F.substring("next_text", F.lit(1), half)).alias("edited"), "own", "next")
    rows = with_signatures(rows, "edited", "changed")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next"), F.size("own").cast("long").alias("n_signatures"),
    )


def similar(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of representatives of equal fingerprints, and members (doc_id, a).

    Sets are partitioned by length so that similar ones lie in one class or the next. They meet on their prefix, the
    signatures that the fewest sets have first, without which no similar pair can do, and then are compared in full.
    A representative is the smallest doc_id of its fingerprint, null where all are; sets go by fingerprint, so ids may repeat.
    """
    rows = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "own").where(F.size("own") > 0)
    rows = rows.select("doc_id", "own", F.sha2(as_text("own"), 256).alias("print"))
    sets = written(rows.groupBy("print").agg(F.min("doc_id").alias("a"), F.first("own").alias("own")), "spots")
    members = rows.select("doc_id", "print").join(sets.select("print", "a"), "print").select("doc_id", "a")
    spots = sets.select("print", F.explode("own").alias("spot"))
    often = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("often")).withColumn("rows", F.col("often"))
    rare = F.sort_array(F.collect_list(F.struct("often", "spot"))).getField("spot")
    sorted_sets = heavy_join(spots, often, "spot", "rows").groupBy("print").agg(rare.alias("rare"))
    n = F.size("rare")
    length = F.floor(F.log(n.cast("double")) / math.log(1 / least)).cast("int")
    prefix = F.slice("rare", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1)
    prefixes = written(sorted_sets.select("print", n.alias("n"), length.alias("class"), prefix.alias("prefix")), "spots-prefixes")
    small = prefixes.select(F.col("print").alias("p"), "n", F.explode(F.array("class", F.col("class") + 1)).alias("class"), "prefix").select("p", "n", "class", F.explode("prefix").alias("spot"))
    large = prefixes.select(F.col("print").alias("q"), F.col("n").alias("m"), "class", F.explode("prefix").alias("spot"))
    meet = small.join(large, ["class", "spot"]).where("(n < m OR (n = m AND p < q)) AND n >= m * %r" % (least - 1e-12)).select("p", "q").distinct()
    full = meet.join(sets.select(F.col("print").alias("p"), "a", F.col("own").alias("x")), "p").join(sets.select(F.col("print").alias("q"), F.col("a").alias("b"), F.col("own").alias("y")), "q")
    pairs = full.select("a", "b", likeness("x", "y").alias("likeness")).where(F.col("likeness") >= least)
    ordered = F.col("b").isNull() | (F.col("a") <= F.col("b"))  # nulls last
    return pairs.select(F.when(ordered, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ordered, F.col("b")).otherwise(F.col("a")).alias("b"), "likeness"), members
