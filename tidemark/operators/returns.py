"""Returns and features by ticker, and the market-model event study."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import finite, present, t_stat


def by_ticker():
    return W.partitionBy("ticker").orderBy("date")


def with_returns(prices: DataFrame) -> DataFrame:
    """prices with ret, close over the ticker's last close; rows without close are dropped before."""
    return prices.where(present("close")).withColumn("ret", F.try_divide("close", F.lag("close").over(by_ticker())) - 1)


def daily_returns(prices: DataFrame) -> DataFrame:
    return with_returns(prices).where(present("ret"))


def trade_returns(prices: DataFrame, delay: int, horizon: int) -> DataFrame:
    """Return of entering `delay` rows after a row and holding for `horizon` rows of the ticker."""
    return prices.withColumn("trade_ret", F.try_divide(F.lead("close", delay + horizon).over(by_ticker()), F.lead("close", delay).over(by_ticker())) - 1)


def rolling_features(prices: DataFrame) -> DataFrame:
    """Momentum, volatility and dollar volume from rows before the current one; null until a frame is full."""

    def full(value, what: str, k: int):
        frame = by_ticker().rowsBetween(-k, -1)
        return F.when(F.count(what).over(frame) == k, value.over(frame))

    rows = with_returns(prices).withColumns({"gross": 1 + F.col("ret"), "dollars": F.col("close") * F.col("volume")})
    return rows.withColumns({
        "mom_1d": F.lag("ret").over(by_ticker()),
        "mom_5d": full(F.product("gross"), "ret", 5) - 1,
        "mom_20d": full(F.product("gross"), "ret", 20) - 1,
        "vol_20d": full(F.stddev_samp("ret"), "ret", 20),
        "dollar_vol_20d": full(F.avg("dollars"), "dollars", 20),
    }).drop("gross", "dollars")


def align(events: DataFrame, returns: DataFrame, how: str = "left_semi") -> DataFrame:
    """Events whose ticker has a return on their very date, or with left_anti those that miss it."""
    keys = returns.select("ticker", F.col("date").alias("trade_date"))
    return events.join(keys, ["ticker", "trade_date"], how)


def joint_returns(returns: DataFrame, market: str) -> DataFrame:
    """(ticker, date, ret, mkt, pos, n): returns beside the market's, and each row's place among the ticker's n rows."""
    mkt = returns.where((F.col("ticker") == market) & present("ret")).select("date", F.col("ret").alias("mkt"))
    joint = returns.where((F.col("ticker") != market) & present("ret")).select("ticker", "date", "ret").join(F.broadcast(mkt), "date")  # a row for each day
    return joint.withColumns({"pos": F.row_number().over(by_ticker()) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("ticker"))})


def market_fits(joint: DataFrame, first: int = -120, last: int = -22) -> DataFrame:
    """joint with alpha, beta and n_est of the rows first..last around each, null without such rows or a market that moved in them.

    A window's moments are the difference of two rows of running sums, so a row costs the same whatever the window's length. Sums are of
    deviations from the ticker's means, which keeps the digits that large running sums of raw values would lose.
    """
    whole, run = W.partitionBy("ticker"), by_ticker().rowsBetween(W.unboundedPreceding, 0)
    rows = joint.withColumns({"_mx": F.avg("mkt").over(whole), "_my": F.avg("ret").over(whole)}).withColumns({"_x": F.col("mkt") - F.col("_mx"), "_y": F.col("ret") - F.col("_my")})
    sums = {"_sn": F.lit(1), "_sx": F.col("_x"), "_sy": F.col("_y"), "_sxx": F.col("_x") * F.col("_x"), "_sxy": F.col("_x") * F.col("_y")}
    rows = rows.withColumns({name: F.sum(value).over(run) for name, value in sums.items()})

    def within(name: str):
        return F.coalesce(F.lag(name, -last).over(by_ticker()), F.lit(0)) - F.coalesce(F.lag(name, 1 - first).over(by_ticker()), F.lit(0))

    rows = rows.withColumns({f"{name}_w": within(name) for name in sums})
    n, x, y, xx, xy = (F.col(f"{name}_w") for name in sums)
    x, y = F.try_divide(x, n), F.try_divide(y, n)
    spread = xx - n * x * x
    rows = rows.withColumn("beta", F.when((n > 1) & (spread > 1e-12 * F.col("_sxx")), (xy - n * x * y) / spread))
    alpha = (F.col("_my") + y) - F.col("beta") * (F.col("_mx") + x)
    return rows.withColumns({"alpha": alpha, "n_est": n.cast("long")}).select(*joint.columns, "alpha", "beta", "n_est")


def study_events(events: DataFrame, joint: DataFrame, before: int = 120, after: int = 5) -> DataFrame:
    """Events with a whole estimation and event window and a fit; joint is market_fits()."""
    at = joint.select("ticker", F.col("date").alias("trade_date"), "pos", "n", "alpha", "beta", "n_est")
    found = events.join(at, ["ticker", "trade_date"]).where((F.col("pos") >= before) & (F.col("pos") + after < F.col("n")))
    return found.where(F.col("alpha").isNotNull())


def abnormal_returns(study: DataFrame, joint: DataFrame, first: int = -10, last: int = 5) -> DataFrame:
    """(event_id, tau, ar) for each event and trading row first..last around it."""
    days = study.select("event_id", "ticker", "alpha", "beta", F.col("pos").alias("at"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("tau")).withColumn("pos", F.col("at") + F.col("tau"))
    return days.join(joint.select("ticker", "pos", "ret", "mkt"), ["ticker", "pos"]).select("event_id", "tau", (F.col("ret") - (F.col("alpha") + F.col("beta") * F.col("mkt"))).alias("ar"))


def mean_by_tau(ar: DataFrame) -> DataFrame:
    """Mean abnormal return by event day; not cumulated."""
    return ar.groupBy("tau").agg(F.avg("ar").alias("caar"), F.count("ar").alias("n_events"))


def event_cars(ar: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Sums of abnormal returns over each window, in one pass and in the order of days, so that equal events have equal sums to the last bit."""
    days = ar.where(F.col("ar").isNotNull()).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("tau", "ar"))).alias("days"))  # a few rows for each event

    def total(first: int, last: int):
        own = F.filter("days", lambda x: x["tau"].between(first, last))
        return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda sum_, x: sum_ + x["ar"]))

    return days.select("event_id", *[total(*span).alias(name) for name, span in windows.items()])


def subgroup_tests(cars: DataFrame, groups: list[str], metrics: list[str], least: int = 100) -> DataFrame:
    """(group, split, metric, n, mean, t_stat) of all events and of each group of at least `least`."""
    long = cars.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("m")).select(*groups, "m.*").where(finite("x"))
    splits = F.explode(F.array(F.struct(F.lit("ALL").alias("group"), F.lit("ALL").alias("split")), *[F.struct(F.lit(g).alias("group"), F.col(g).alias("split")) for g in groups]))
    out = long.select(splits.alias("g"), "metric", "x").select("g.*", "metric", "x").where("split is not null").groupBy("group", "split", "metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), t_stat("x").alias("t_stat"))
    return out.where((F.col("group") == "ALL") | (F.col("n") >= least))


def false_discovery(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with q by Benjamini and Hochberg; a single null p makes every q null. A table of tests is small."""
    order = W.orderBy(p, *[c for c in tests.columns if c != p])
    rows = tests.withColumns({"_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(W.partitionBy()), "_known": F.count(p).over(W.partitionBy())})
    ahead = order.rowsBetween(0, W.unboundedFollowing)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_k")).over(ahead))
    return rows.withColumn("q", F.when(F.col("_known") == F.col("_n"), q)).drop("_k", "_n", "_known")


def _poisson() -> np.ndarray:
    """Poisson(1) by each of 65536 equal shares of probability."""
    cumulative = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return np.searchsorted(cumulative, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _weights(hashes: np.ndarray, draws: int) -> np.ndarray:
    """(row, draw) weights; a mixed number gives four draws."""
    x = hashes.astype(np.uint64)[:, None] + np.arange(1, -(-draws // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return _poisson()[x.view(np.uint16)[:, :draws]]


def _summed(keys: list[str], column: str):
    """Rows of equal keys with their arrays added up, a row a key for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            arrays = batch.column(column)
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                own = arrays[i].values.to_numpy()
                sums[key] = sums[key] + own if key in sums else own.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in zip(*sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=[*keys, column])

    return run


def bootstrap_sums(cars: DataFrame, groups: list[str], metrics: list[str], draws: int, salts: int = 32) -> DataFrame:
    """(group, split, sums) of all events and of each group: for each metric, its weighed sums and weights of all draws, one after the other.

    An event is drawn once for all tests. A task keeps the sums of each cell of all groups and sends a row a cell; rows are added up by cell in `salts`
    parts, then by split, so that no task adds up all tasks' rows.
    """
    rows = cars.select(F.xxhash64("event_id").alias("h"), *[F.col(g).cast("string").alias(g) for g in groups], *[F.col(m).cast("double").alias(m) for m in metrics])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            cells = list(zip(*(batch.column(g).to_pylist() for g in groups)))
            number = {c: i for i, c in enumerate(dict.fromkeys(cells))}
            own = np.array([number[c] for c in cells])
            x = np.stack([batch.column(m).to_numpy(zero_copy_only=False).astype(np.float64) for m in metrics], axis=1)
            there = np.isfinite(x)
            both = np.concatenate([np.where(there, x, 0.0), there], axis=1)
            hashes = batch.column("h").to_numpy()
            for cell, i in number.items():
                at = np.flatnonzero(own == i)
                for part in np.array_split(at, -(-len(at) // 256)):
                    got = both[part].T @ _weights(hashes[part], draws).astype(np.float64)
                    sums[cell] = sums[cell] + got if cell in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in zip(*sums)), pa.array([v.ravel() for v in sums.values()], pa.list_(pa.float64()))], names=[*groups, "sums"])

    cells = rows.mapInArrow(drawn, ", ".join(f"`{g}` string" for g in groups) + ", sums array<double>")
    cells = cells.repartition(salts, *groups, F.spark_partition_id() % salts).mapInArrow(_summed(groups, "sums"), cells.schema)
    splits = F.explode(F.array(F.struct(F.lit("ALL").alias("group"), F.lit("ALL").alias("split")), *[F.struct(F.lit(g).alias("group"), F.col(g).alias("split")) for g in groups]))
    by_split = cells.select(splits.alias("g"), "sums").select("g.*", "sums").where("split is not null")
    return by_split.repartition("group", "split").mapInArrow(_summed(["group", "split"], "sums"), "group string, split string, sums array<double>")


def bootstrap_tests(cars: DataFrame, groups: list[str], metrics: list[str], draws: int = 2000, least: int = 100) -> DataFrame:
    """subgroup_tests() with boot_p: share of uncentred resample means at least as far from 0 as the mean; null below five rows.

    Resampling is by Poisson weights from hashes, so groups are never gathered.
    """
    cars = cars.withColumns({m: F.when(finite(m), F.col(m)) for m in metrics})
    sums = bootstrap_sums(cars, groups, metrics, draws)
    part = lambda i: F.slice("sums", i * draws + 1, draws)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.zip_with(part(i), part(len(metrics) + i), F.try_divide).alias("means")) for i, m in enumerate(metrics)]))
    means = sums.select("group", "split", each.alias("m")).select("group", "split", "m.*")
    tests = subgroup_tests(cars, groups, metrics, least)
    keys = ["group", "split", "metric"]
    drawn = F.filter("means", lambda m: m.isNotNull())
    share = F.try_divide(F.size(F.filter(drawn, lambda m: F.abs(m) >= F.abs("mean"))).cast("double"), F.size(drawn))
    return tests.join(means, keys, "left").select(*keys, "n", "mean", "t_stat", F.when(F.col("n") >= 5, share).alias("boot_p"))
