"""Model dataset, walk-forward folds, metrics and the models themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import present
from tidemark.operators import linear
from tidemark.operators.boosting import Boosting, fit_folds, scored
from tidemark.operators.places import mean_ranks
from tidemark.sources.tables import shared_folder, written

FEATURES = ["mom_1d", "mom_5d", "mom_20d", "vol_20d", "dollar_vol_20d"]
BLOCK = 50_000
NUMBERS, CATEGORIES = [*FEATURES, "dow", "month"], ["form", "session_bucket"]


def model_dataset(study: DataFrame, labels: DataFrame, features: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Study events with label and features of their day, weekday (Monday is 0), month and columns to carry; rows without a feature go."""
    at = features.select("ticker", F.col("date").alias("trade_date"), *FEATURES)
    out = study.join(labels, "event_id").join(at, ["ticker", "trade_date"], "left").na.drop(subset=[*FEATURES, "y"])
    return out.select("event_id", "ticker", "form", "trade_date", "y", *FEATURES, F.weekday("trade_date").cast("bigint").alias("dow"), F.month("trade_date").cast("bigint").alias("month"), *(carry or []))


def folds(dates: DataFrame, splits: int = 5, purge: int = 7, embargo: int = 5) -> DataFrame:
    """(fold, role, date): contiguous test blocks of the distinct dates; training is what lies more than `purge` days before.

    The embargo after a block can't bind, as training never follows a test block. Folds without training dates are dropped.
    """
    days = dates.select("date").where("date is not null").distinct().withColumn("fold", F.ntile(splits).over(W.orderBy("date")) - 1)
    starts = days.groupBy("fold").agg(F.min("date").alias("start"))
    train = days.select("date").crossJoin(F.broadcast(starts)).where(F.col("date") < F.date_sub("start", purge))  # `splits` rows
    kept = train.select("fold").distinct()
    test = days.join(kept, "fold", "left_semi")
    return train.select("fold", F.lit("train").alias("role"), "date").unionByName(test.select("fold", F.lit("test").alias("role"), "date"))


def regression_metrics(df: DataFrame, keys: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    """mse, r2, pearson, spearman and hit_rate; correlations need more than two rows."""
    rows = mean_ranks(mean_ranks(df.select(*keys, F.col(y).alias("y"), F.col(p).alias("p")).where(present("y", "p")), keys, "y", "ry"), keys, "p", "rp")
    y, p = "y", "p"
    n, some = F.count(F.lit(1)), F.count(F.lit(1)) > 2
    sse = F.sum(F.pow(F.col(y) - F.col(p), F.lit(2)))
    return rows.groupBy(*keys).agg(
        n.alias("n_test"), (sse / n).alias("mse"), (1 - F.try_divide(sse, n * F.var_pop(y))).alias("r2"), F.when(some, F.corr(y, p)).alias("pearson"), F.when(some, F.corr("ry", "rp")).alias("spearman"),
        F.avg(((F.col(y) > 0) == (F.col(p) > 0)).cast("double")).alias("hit_rate"),
    )


def class_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, mean predicted and true rate of sign(y) for probabilities prob."""
    truth = (F.col("y") > 0).cast("double")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.avg(((F.col("prob") > 0.5).cast("double") == truth).cast("double")).alias("accuracy"), F.avg("prob").alias("pos_rate_pred"), F.avg(truth).alias("pos_rate_true"))


def _checkpoints(spark) -> None:
    """Boosting cuts its lineage every few trees in the context's checkpoint folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def boosted(data: DataFrame, splits: int, settings: Boosting) -> DataFrame:
    """walk_forward() by boosted trees, all folds in the same jobs."""
    _checkpoints(data.sparkSession)
    marks = written(folds(data.select(F.col("trade_date").alias("date")), splits).withColumnRenamed("date", "trade_date"), "folds")
    roles = {r: data.join(F.broadcast(marks.where(F.col("role") == r).drop("role")), "trade_date") for r in ("train", "test")}  # days x folds
    train = written(roles["train"].select("fold", "event_id", "y", *NUMBERS, *CATEGORIES), "boosting-rows")
    models, layout = fit_folds(train, NUMBERS, CATEGORIES, settings, BLOCK)
    spans = F.broadcast(marks.where("role = 'test'").groupBy("fold").agg(F.min("trade_date").alias("test_start"), F.max("trade_date").alias("test_end")))
    test = roles["test"].select("fold", "event_id", "ticker", F.col("trade_date").alias("date"), "y", *NUMBERS, *CATEGORIES)
    return scored(test, models, layout, ["ticker", "date", "y"]).join(spans, "fold").select("event_id", "ticker", "date", "fold", "test_start", "test_end", "y", "pred")


def walk_forward(data: DataFrame, model: str, splits: int = 5, alpha: float = 10.0, c: float = 1.0, least_train: int = 200, least_test: int = 50, boosting: Boosting | None = None) -> DataFrame:
    """Out-of-sample rows (event_id, ticker, date, fold, test_start, test_end, y, pred) of a ridge, logit or gbt model, a model for each fold.

    Small folds are left out of ridge and logit alone.
    """
    if model == "gbt":
        return boosted(data, splits, boosting or Boosting())
    marks = written(folds(data.select(F.col("trade_date").alias("date")), splits).withColumnRenamed("date", "trade_date"), "folds")
    days = data.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    sizes = days.join(F.broadcast(marks), "trade_date").groupBy("fold").agg(F.sum(F.when(F.col("role") == "train", F.col("n"))).alias("train"), F.sum(F.when(F.col("role") == "test", F.col("n"))).alias("test"))
    some = [r.fold for r in sizes.collect() if (r.train or 0) >= least_train and (r.test or 0) >= least_test]
    marks = marks.where(F.col("fold").isin(some))
    x = linear.design(data, NUMBERS, CATEGORIES)
    weights = linear.fit_ridge(data, marks, x, alpha) if model == "ridge" else linear.fit_logit(data, marks, x, c)
    test = marks.where("role = 'test'").drop("role")
    spans = F.broadcast(days.join(F.broadcast(test), "trade_date").groupBy("fold").agg(F.min("trade_date").alias("test_start"), F.max("trade_date").alias("test_end")))
    out = linear.scored(data.join(F.broadcast(test), "trade_date"), weights, x, "pred").join(spans, "fold")
    pred = F.col("pred") if model == "ridge" else 1 / (1 + F.exp(-F.col("pred")))
    return out.select("event_id", "ticker", F.col("trade_date").alias("date"), "fold", "test_start", "test_end", "y", pred.alias("pred"))
