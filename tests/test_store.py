"""Kept stages, their reuse and their end; exact quantiles."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import places, returns
from tidemark.plans.registry import QUERIES
from tidemark.sources import store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folders(spark):
    return [spark.table(t).inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/") for t in store.stages(spark)]


def test_stages_are_written_once_and_go(spark):
    before = store.stages(spark)
    store.drop_stages(spark)
    with store.kept(spark):
        first = sorted(map(tuple, QUERIES["caar"](spark, SF).collect()))
        names, made = store.stages(spark), folders(spark)
        changed = {f: os.stat(f).st_mtime_ns for f in made}
        assert sorted(n.split("_")[2] for n in names) == ["joint", "prices", "study"]
        assert sorted(map(tuple, QUERIES["caar"](spark, SF).collect())) == first
        QUERIES["event_cars"](spark, SF).count()
        assert store.stages(spark) == names and {f: os.stat(f).st_mtime_ns for f in folders(spark)} == changed
    assert store.stages(spark) == [] and not any(map(os.path.exists, made))
    assert not set(before) & set(store.stages(spark))


def test_stages_follow_inputs_and_settings(spark, tmp_path):
    path, runs = f"{tmp_path}/t", []

    def ask(by=None, **settings):
        def make():
            runs.append(settings)
            return spark.read.parquet(path).limit(settings.get("most", 100))

        return store.stage(spark, "t", [path], settings, make, by=by).count()

    with store.kept(spark):
        spark.range(10).write.parquet(path)
        assert (ask(), ask(), len(runs)) == (10, 10, 1)
        assert (ask(most=3), len(runs)) == (3, 2)
        assert (ask(by="id"), len(runs)) == (10, 3)
        spark.range(5).write.mode("append").parquet(path)
        assert (ask(), len(runs)) == (15, 4)
        for table in store.stages(spark):  # folders that were cleared are made again
            place = spark._jvm.org.apache.hadoop.fs.Path(store._location(spark, table))
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        assert (ask(), ask(), ask(most=3), len(runs)) == (15, 15, 3, 6)


def test_a_failed_stage_is_not_named(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    bad = lambda: spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    before = store.stages(spark)
    try:
        store.stage(spark, "bad", [f"{tmp_path}/t"], {}, bad)
        raise AssertionError("a broken stage was kept")
    except Exception as e:
        assert "broken stage" not in str(e)
    assert store.stages(spark) == before
    assert store.stage(spark, "bad", [f"{tmp_path}/t"], {}, lambda: spark.range(3)).count() == 3
    store.drop_stages(spark, [t for t in store.stages(spark) if t not in before])


def test_bucketed_prices_need_no_exchange(spark):
    with store.kept(spark):
        for name in ("daily_returns", "rolling_features", "trade_return_cc"):
            out = QUERIES[name](spark, SF)
            assert out.count() and "Exchange" not in plan(out), name
        prices = spark.table(next(t for t in store.stages(spark) if "prices" in t))
        assert "Exchange" not in plan(returns.daily_returns(prices).groupBy("ticker").agg(F.avg("ret")))


def test_quantiles_against_numpy(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(4), rng.choice([1.5, rng.gauss(0, 1), None, 3.0])) for _ in range(3000)] + [(7, 2.0), (8, None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    for at in (0.0, 0.3, 0.95, 1.0):
        got = {r.k: r.q for r in places.quantile(df, ["k"], "x", at, "q").collect()}
        groups = {k: [x for j, x in rows if j == k and x is not None] for k in {r[0] for r in rows if r[1] is not None}}
        groups.pop(None)
        assert {k: v for k, v in got.items() if k is not None}.keys() == groups.keys() and 8 not in got
        assert all(abs(got[k] - np.quantile(v, at)) < 1e-12 for k, v in groups.items())
    many = spark.range(1000000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 1000003).cast("double").alias("x"))
    want = np.quantile(np.arange(1000000, dtype=np.int64) * 7919 % 1000003, 0.95)
    assert abs(places.quantile(many, ["k"], "x", 0.95, "q").first().q - want) < 1e-6
    assert places.quantile(df.limit(0), ["k"], "x", 0.5, "q").count() == 0
