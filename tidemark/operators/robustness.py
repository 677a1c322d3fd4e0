"""Prediction sets that should carry no signal, and subsamples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.places import placed


def _mark(seed: int):
    return F.md5(F.concat(F.col("event_id").cast("string"), F.lit(f"|{seed}")))


def shuffled(preds: DataFrame, keys: list[str], column: str, seed: int = 42) -> DataFrame:
    """preds with column dealt anew within keys, in the order of a hash of the id; no task sorts all rows of a key."""
    to = placed(preds, keys, [], [F.col("event_id")]).drop("_all")
    source = placed(preds.select(*keys, "event_id", F.col(column).alias("_x"), _mark(seed).alias("_k")), keys, [F.col("_k")], [F.col("event_id")])
    return to.drop(column).join(source.select(*keys, "_place", "_x"), [*keys, "_place"]).drop("_place").withColumnRenamed("_x", column)


def random_predictions(preds: DataFrame, seed: int = 42) -> DataFrame:
    """Standard normal predictions, the same for an id in every run."""
    u = lambda salt: (F.xxhash64("event_id", F.lit(seed), F.lit(salt)) / F.lit(2.0**64)) + 0.5
    return preds.withColumn("pred", F.sqrt(-2 * F.log(F.greatest(u(1), F.lit(1e-300)))) * F.cos(2 * F.pi() * u(2)))


def by_year(preds: DataFrame, least: int = 200) -> DataFrame:
    """preds as pred_set ALL, and again as the set of their year where it has at least `least`."""
    rows = preds.withColumn("_year", F.year("date").cast("string"))
    sizes = F.broadcast(rows.groupBy("_year").agg(F.count(F.lit(1)).alias("_n")))  # a row for each year
    sets = F.when(F.col("_n") >= least, F.array(F.lit("ALL"), "_year")).otherwise(F.array(F.lit("ALL")))
    return rows.join(sizes, "_year", "left").withColumn("pred_set", F.explode(sets)).drop("_year", "_n")


def sanity_sets(preds: DataFrame) -> DataFrame:
    """preds (event_id, ticker, date, pred, y_true) as they are, random, as labels dealt anew with 0 for none, and dealt anew within days."""
    labels = preds.withColumn("pred", F.coalesce(F.nanvl("y_true", F.lit(0.0)), F.lit(0.0)))
    sets = {"base_oos_pred": preds, "random_predictions": random_predictions(preds), "shuffled_labels_proxy": shuffled(labels, [], "pred"), "within_day_shuffle": shuffled(preds, ["date"], "pred")}
    out = None
    for name, rows in sets.items():
        rows = rows.select(F.lit(name).alias("pred_set"), "event_id", "ticker", "date", "pred")
        out = rows if out is None else out.unionByName(rows)
    return out
