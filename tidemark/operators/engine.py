"""Portfolio backtest of many scenarios as joins and windows.

A book is what (pred_set, delay, horizon, q, limits) make of predictions; scenarios add costs and a volatility
target to a book's days.  Positions are runs of days between a ticker's changes of state, so only active
days are ever made.  Windows over dates run by book or scenario, over as many rows as there are days.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import present, sharpe
from tidemark.operators.cleaning import next_session, sessions
from tidemark.operators.longshort import basket, ranked
from tidemark.operators.places import quantile
from tidemark.sources.tables import written


# The settings' names and defaults of the reference.
@dataclass(frozen=True)
class Scenario:
    scenario_id: int = 0
    pred_set: str = "base"
    q: float = 0.2
    delay_days: int = 1
    horizon_days: int = 5
    cost_bps: float = 2.0
    max_positions: int = 20
    name_cap: float = 0.10
    gross_target: float = 1.0
    vol_target: float | None = None
    vol_lookback: int = 60
    min_positions: int = 2


BOOK = ["pred_set", "q", "delay_days", "horizon_days", "max_positions", "name_cap", "gross_target", "min_positions"]
_SCHEMA = "scenario_id int, pred_set string, q double, delay_days int, horizon_days int, cost_bps double, max_positions int, name_cap double, gross_target double, vol_target double, vol_lookback int, min_positions int"


def scenario_table(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    """Scenarios with book_id, the number of their distinct book."""
    rows = [asdict(s) for s in scenarios]
    books = {k: i for i, k in enumerate(dict.fromkeys(tuple(r[c] for c in BOOK) for r in rows))}
    return spark.createDataFrame([(*r.values(), books[tuple(r[c] for c in BOOK)]) for r in rows], _SCHEMA + ", book_id int")


def signal_trades(preds: DataFrame, calendar: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, ticker, entry, exit, side, date, rn): the first and last k of each day's predictions.

    Rows without ticker, date or prediction, days with fewer than max(2, min_positions) of the others, and trades that leave the
    calendar are dropped.
    """
    preds = preds.where(F.col("ticker").isNotNull() & F.col("date").isNotNull() & present("pred"))
    base = next_session(preds.select("date"), calendar).withColumnsRenamed({"d": "date", "pos": "base"})
    days = F.broadcast(calendar.agg(F.count(F.lit(1)).cast("int").alias("days")))
    rows = ranked(preds, ["pred_set", "date"]).join(base, "date").join(F.broadcast(books), "pred_set").crossJoin(days)
    rows = rows.where(F.col("n") >= F.greatest(F.lit(2), F.col("min_positions"))).withColumn("k", F.least(basket(F.col("q")), F.floor(F.col("n") / 2).cast("int")))
    side = F.when(F.col("rn") <= F.col("k"), 1).when(F.col("rn") > F.col("n") - F.col("k"), -1)
    rows = rows.withColumns({"side": side, "entry": F.col("base") + F.col("delay_days")}).withColumn("exit", F.col("entry") + F.col("horizon_days"))
    return rows.where("side is not null and exit < days").select("book_id", "ticker", "entry", "exit", "side", "date", "rn")


def active_book(trades: DataFrame, days: int | DataFrame) -> DataFrame:
    """(book_id, pos, ticker, side) of every active day.

    On a day exits close the ticker, whoever opened it; then entries set its side, the last one winning in the
    order of exit, formation date, long before short, and rank.
    """
    entry = trades.select("book_id", "ticker", F.col("entry").alias("pos"), F.struct("exit", "date", (-F.col("side")).alias("order"), "rn", "side").alias("opened"))
    leave = trades.select("book_id", "ticker", F.col("exit").alias("pos"), F.lit(None).cast(entry.schema["opened"].dataType).alias("opened"))
    state = entry.unionByName(leave).groupBy("book_id", "ticker", "pos").agg(F.max("opened").alias("opened"))
    state = state.withColumn("until", F.lead("pos").over(W.partitionBy("book_id", "ticker").orderBy("pos")))
    if isinstance(days, int):
        state = state.withColumn("days", F.lit(days))
    else:
        state = state.crossJoin(F.broadcast(days))
    held = state.where("opened is not null").withColumn("last", F.coalesce("until", "days") - 1).where("last >= pos")
    return held.select("book_id", F.explode(F.sequence("pos", "last")).alias("pos"), "ticker", F.col("opened.side").alias("side"))


def limited(active: DataFrame, books: DataFrame) -> DataFrame:
    """active without what is above max_positions, sides in balance, tickers in alphabetical order first."""
    day = W.partitionBy("book_id", "pos")
    rows = active.join(F.broadcast(books.select("book_id", "max_positions")), "book_id").withColumns({
        "longs": F.sum((F.col("side") > 0).cast("int")).over(day), "shorts": F.sum((F.col("side") < 0).cast("int")).over(day),
        "place": F.row_number().over(W.partitionBy("book_id", "pos", "side").orderBy("ticker")),
    })
    most, half = F.col("max_positions"), F.floor(F.col("max_positions") / 2).cast("int")
    n_short = F.least(F.col("shorts"), most - F.least(F.col("longs"), half))
    n_long = F.when(n_short < most - half, F.least(F.col("longs"), most - n_short)).otherwise(F.least(F.col("longs"), half))
    keep = (F.col("longs") + F.col("shorts") <= most) | (F.col("place") <= F.when(F.col("side") > 0, n_long).otherwise(n_short))
    return rows.where(keep).select("book_id", "pos", "ticker", "side")


def weights(positions: DataFrame, books: DataFrame) -> DataFrame:
    """positions with raw, capped and w: equal weights clipped to the cap and scaled back to the gross target."""
    day = W.partitionBy("book_id", "pos")
    rows = positions.join(F.broadcast(books.select("book_id", "name_cap", "gross_target")), "book_id")
    rows = rows.withColumn("raw", F.col("side") * F.col("gross_target") / F.count(F.lit(1)).over(day))
    rows = rows.withColumn("capped", F.greatest(-F.col("name_cap"), F.least(F.col("name_cap"), F.col("raw"))))
    scale = F.try_divide(F.col("gross_target"), F.sum(F.abs("capped")).over(day))
    return rows.withColumn("w", F.col("capped") * F.coalesce(scale, F.lit(0.0))).select("book_id", "pos", "ticker", "side", "raw", "capped", "w")


def book_days(w: DataFrame, returns: DataFrame, calendar: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, pos, date, n_active, n_long, n_short, gross_exposure, turnover, gross) of every day of the calendar."""
    paid = w.join(F.broadcast(calendar), "pos").join(returns.where(present("ret")).select("ticker", "date", "ret"), ["ticker", "date"], "left")
    held = paid.groupBy("book_id", "pos").agg(
        F.count(F.lit(1)).alias("n_active"), F.sum((F.col("side") > 0).cast("bigint")).alias("n_long"), F.sum((F.col("side") < 0).cast("bigint")).alias("n_short"),
        F.sum(F.abs("w")).alias("gross_exposure"), F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross"),
    )
    change = w.select("book_id", "pos", "ticker", "w").unionByName(w.select("book_id", (F.col("pos") + 1).alias("pos"), "ticker", (-F.col("w")).alias("w")))
    turnover = change.groupBy("book_id", "pos", "ticker").agg(F.sum("w").alias("d")).groupBy("book_id", "pos").agg(F.sum(F.abs("d")).alias("turnover"))
    grid = calendar.crossJoin(F.broadcast(books.select("book_id").distinct()))  # days times books
    out = grid.join(held, ["book_id", "pos"], "left").join(turnover, ["book_id", "pos"], "left")
    return out.na.fill(0)


def scenario_days(days: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Days of every scenario: costs, leverage, gross and net return, and equity."""
    s = scenarios.select("scenario_id", "book_id", "cost_bps", "vol_target", "vol_lookback")
    by = W.partitionBy("scenario_id").orderBy("pos")
    rows = days.join(F.broadcast(s), "book_id").withColumn("cost0", F.col("turnover") * F.col("cost_bps") * 1e-4).withColumn("net0", F.col("gross") - F.col("cost0"))
    # one trailing frame for each lookback in use; a scenario reads its own
    levers = F.lit(1.0)
    for lookback in sorted({r[0] for r in scenarios.where("vol_target is not null").select("vol_lookback").distinct().collect()}):
        frame = by.rowsBetween(1 - lookback, 0)
        sd = F.stddev_samp("net0").over(frame)
        full = F.when((F.count("net0").over(frame) >= lookback) & (sd > 0), F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.col("vol_target") / (sd * F.sqrt(F.lit(252.0))))))
        levers = F.when(F.col("vol_target").isNotNull() & (F.col("vol_lookback") == lookback), F.coalesce(full, F.lit(1.0))).otherwise(levers)
    rows = rows.withColumn("lev", levers).withColumns({"cost": F.col("cost0") * F.col("lev"), "ret_gross": F.col("gross") * F.col("lev"), "ret_net": F.col("net0") * F.col("lev")})
    rows = rows.withColumns({"g": 1 + F.col("ret_gross"), "m": 1 + F.col("ret_net")})
    run = by.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"equity_gross": F.product("g").over(run), "equity_net": F.product("m").over(run)})
    return rows.select("scenario_id", "date", "n_active", "n_long", "n_short", "gross_exposure", "turnover", "cost", "lev", "ret_gross", "ret_net", "equity_gross", "equity_net")


def summary(daily: DataFrame) -> DataFrame:
    """One row for each scenario."""
    run = W.partitionBy("scenario_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = daily.withColumns({f"dd_{x}": F.col(f"equity_{x}") / F.max(f"equity_{x}").over(run) - 1 for x in ("gross", "net")})
    return rows.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("days"), sharpe("ret_gross").alias("sharpe_gross"), sharpe("ret_net").alias("sharpe_net"), F.min("dd_gross").alias("maxdd_gross"), F.min("dd_net").alias("maxdd_net"),
        F.avg("turnover").alias("mean_turnover"), F.avg("cost").alias("mean_cost"), F.avg("n_active").alias("avg_active"), F.avg("n_long").alias("avg_long"), F.avg("n_short").alias("avg_short"),
    )


def extras(daily: DataFrame) -> DataFrame:
    """Exposure, leverage, its 95th percentile, and costs as a share of absolute gross returns."""
    daily = written(daily, "days")
    of = daily.groupBy("scenario_id").agg(F.avg("gross_exposure").alias("avg_gross_exposure"), F.avg("lev").alias("avg_lev"), F.try_divide(F.sum("cost"), F.sum(F.abs("ret_gross"))).alias("cost_share"))
    return of.join(quantile(daily, ["scenario_id"], "lev", 0.95, "p95_lev"), "scenario_id", "left")


def backtest(returns: DataFrame, preds: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Daily rows of all scenarios; preds are (pred_set, event_id, ticker, date, pred)."""
    books = scenarios.select("book_id", *BOOK).distinct()
    calendar = sessions(returns)
    trades = signal_trades(preds, calendar, books)
    active = active_book(trades, calendar.agg(F.count(F.lit(1)).cast("int").alias("days")))
    held = written(weights(limited(active, books), books), "weights")  # read by returns and both sides of turnover
    return scenario_days(book_days(held, returns, calendar, books), scenarios)
