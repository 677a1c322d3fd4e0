"""Places in an order over more rows than one task should sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import written


def placed(rows: DataFrame, keys: list[str], order: list[Column], ties: list[Column], weight: Column | None = None) -> DataFrame:
    """rows with _place, the rows before it within keys in this order (with weight, the sum of their weights), and _all, those of the key.

    Rows are dealt out by ranges of keys and order, ties included, and written, for ranges are sampled anew each time that a plan runs.
    Tasks number their own rows; what lies in the ranges before is added, a row for each range and key.
    """
    weight = F.lit(1) if weight is None else weight
    by = [*map(F.col, keys), *order, *ties]
    ranged = rows.withColumn("_w", weight.cast("long")).repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy(*keys, "_part").agg(F.sum("_w").alias("_n"))
    whole = W.partitionBy(*keys)
    past = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(past), F.lit(0)), "_all": F.sum("_n").over(whole)}).drop("_n")
    own = W.partitionBy(*keys, "_part").orderBy(*order, *ties).rowsBetween(W.unboundedPreceding, -1)
    inner = ranged.withColumn("_own", F.coalesce(F.sum("_w").over(own), F.lit(0)))
    return inner.join(before, [*keys, "_part"]).withColumn("_place", F.col("_before") + F.col("_own")).drop("_part", "_before", "_own", "_w")


def quantile(rows: DataFrame, keys: list[str], x: str, at: float, name: str) -> DataFrame:
    """(keys, name): the exact quantile of x within keys, between two neighbours in proportion; null values and null keys are left out, keys without values too.

    Values are counted, their places found by ranges, and the values at the two wanted places picked, so no task holds a group's values.
    """
    values = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    ranks = placed(values, keys, [F.col(x)], [], F.col("_c"))
    wanted = F.lit(at) * (F.col("_all") - 1)
    low, high = F.floor(wanted), F.ceil(wanted)
    holds = lambda place: (F.col("_place") <= place) & (place < F.col("_place") + F.col("_c"))
    picked = ranks.where(holds(low) | holds(high)).groupBy(*keys)
    two = picked.agg(F.max(F.when(holds(low), F.col(x))).alias("_low"), F.max(F.when(holds(high), F.col(x))).alias("_high"), F.first(wanted - low).alias("_share"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")
    return two.select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low").cast("double")).otherwise(between).alias(name))


def mean_ranks(rows: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """rows with the average rank of x within keys; equal values are counted first, so they meet in no task."""
    values = rows.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    ranks = placed(values, keys, [F.col(x)], [], F.col("_c")).select(*keys, x, (F.col("_place") + (F.col("_c") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, x])
