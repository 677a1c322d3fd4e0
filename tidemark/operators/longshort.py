"""Long/short baskets from predictions, with and without costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import hit_rate, present, sharpe, t_stat
from tidemark.operators.places import placed


def ranked(df: DataFrame, keys: list[str], pred: str = "pred", tie: str = "event_id") -> DataFrame:
    """df with rn, the place by falling prediction within keys such as days or months, and n, the rows there; rows without prediction go."""
    df, by = df.where(present(pred)), W.partitionBy(*keys)
    return df.withColumns({"rn": F.row_number().over(by.orderBy(F.desc(pred), tie)), "n": F.count(F.lit(1)).over(by)})


def ranked_wide(df: DataFrame, keys: list[str], pred: str = "pred", tie: str = "event_id") -> DataFrame:
    """The same for keys, or none, that hold very many rows each."""
    rows = placed(df.where(present(pred)), keys, [F.desc(pred)], [F.col(tie)])
    return rows.withColumns({"rn": F.col("_place") + 1, "n": F.col("_all")}).drop("_place", "_all")


def basket(q: Column | float) -> Column:
    """floor(q*n), one at least."""
    q = q if isinstance(q, Column) else F.lit(float(q))
    return F.greatest(F.lit(1), F.floor(q * F.col("n")).cast("int"))


def sides(df: DataFrame, keys: list[str], q: float, least: int, y: str) -> DataFrame:
    """Rows of groups of at least `least`, flagged is_long and is_short; with a high q a row can be both. Rows without prediction or outcome y go."""
    df = df.where(present(y))
    rows = (ranked(df, keys) if keys == ["date"] else ranked_wide(df, keys)).where(F.col("n") >= least).withColumn("k", basket(q))
    return rows.withColumns({"is_long": F.col("rn") <= F.col("k"), "is_short": F.col("rn") > F.col("n") - F.col("k")})


def quantile_daily(df: DataFrame, q: float = 0.2, least: int = 10) -> DataFrame:
    """By day: sizes, mean predictions and mean outcomes of both sides, and their difference."""
    mean = lambda c, side: F.avg(F.when(F.col(side), F.col(c)))
    count = lambda side: F.sum(F.col(side).cast("bigint"))
    out = sides(df, ["date"], q, least, "y_true").groupBy("date").agg(
        F.count(F.lit(1)).alias("n_events"), count("is_long").alias("n_long"), count("is_short").alias("n_short"), mean("pred", "is_long").alias("mean_pred_long"),
        mean("pred", "is_short").alias("mean_pred_short"), mean("y_true", "is_long").alias("ret_long"), mean("y_true", "is_short").alias("ret_short"),
    )
    return out.withColumn("ret_ls", F.col("ret_long") - F.col("ret_short"))


def pairs(df: DataFrame, keys: list[str], y: str, q: float = 0.2, least: int = 1) -> DataFrame:
    """The i-th long with the i-th of the last k, and the difference of their outcomes, (keys, i, ls)."""
    rows = sides(df, keys, q, least, y)
    long = rows.where("is_long").select(*keys, F.col("rn").alias("i"), F.col(y).alias("y_long"))
    short = rows.where("is_short").select(*keys, (F.col("rn") - (F.col("n") - F.col("k"))).alias("i"), F.col(y).alias("y_short"))
    return long.join(short, [*keys, "i"]).select(*keys, "i", (F.col("y_long") - F.col("y_short")).alias("ls"))


def summary(ls: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, std, t_stat, sharpe and hit of pair outcomes."""
    return ls.where("ls is not null").groupBy(*keys).agg(F.count("ls").alias("n"), F.avg("ls").alias("mean"), F.stddev_samp("ls").alias("std"), t_stat("ls").alias("t_stat"), sharpe("ls").alias("sharpe"), hit_rate("ls").alias("hit"))


def costed_pairs(ls: DataFrame, cost_bps: float = 2.0) -> DataFrame:
    """Gross and net figures of pairs at a flat cost for both legs."""
    rows = ls.where("ls is not null").withColumns({"gross": F.col("ls"), "net": F.col("ls") - F.lit(2 * cost_bps * 1e-4)})
    return rows.agg(
        F.count("ls").alias("n_pairs"), F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"), F.stddev_samp("gross").alias("std_gross"), F.stddev_samp("net").alias("std_net"),
        sharpe("gross").alias("sharpe_gross"), sharpe("net").alias("sharpe_net"), hit_rate("net").alias("hit_rate"), F.first(F.lit(2 * cost_bps * 1e-4)).alias("cost_per_pair"),
    )


def monthly_baskets(df: DataFrame, keys: list[str], y: str, q: Column | float, least: int = 30, cells: DataFrame | None = None) -> DataFrame:
    """(keys, ym, n_events, k, gross_ls, turnover): baskets by month, turnover against the month kept before.

    cells are further keys, a few rows, that q is made of; places don't depend on them, so only baskets are copied.

    Tickers of a basket are rows and never one list: those also in the basket before are found by a join on ticker and month.
    """
    dated = df.where(present(y)).withColumn("ym", F.date_format("date", "yyyy-MM"))
    rows = ranked_wide(dated, [*keys, "ym"]).where(F.col("n") >= least)
    if cells is not None:
        rows, keys = rows.crossJoin(cells), [*keys, *cells.columns]
    rows = rows.withColumn("k", basket(q))
    long, short = F.col("rn") <= F.col("k"), F.col("rn") > F.col("n") - F.col("k")
    out = rows.groupBy(*keys, "ym").agg(F.max("n").alias("n_events"), F.max("k").alias("k"), (F.avg(F.when(long, F.col(y))) - F.avg(F.when(short, F.col(y)))).alias("gross_ls"))
    past = W.partitionBy(*keys).orderBy("ym") if keys else W.orderBy("ym")  # a row for each month
    months = out.select(*keys, "ym").withColumn("before", F.lag("ym").over(past))
    legs = F.explode(F.array_compact(F.array(F.when(long, F.lit(1)), F.when(short, F.lit(-1))))).alias("leg")
    held = rows.select(*keys, "ym", "ticker", legs).distinct()
    now = held.join(F.broadcast(months), [*keys, "ym"])
    then = held.withColumnsRenamed({"ym": "before"}).withColumn("again", F.lit(1))
    kept = now.join(then, [*keys, "before", "ticker", "leg"], "left").groupBy(*keys, "ym", "before", "leg").agg((F.count("again") / F.count(F.lit(1))).alias("overlap"))
    turnover = kept.groupBy(*keys, "ym").agg(F.when(F.max("before").isNull(), F.lit(1.0)).otherwise(0.5 * F.sum(1 - F.col("overlap"))).alias("turnover"))
    return out.join(turnover, [*keys, "ym"])


def with_costs(months: DataFrame, bps: Column | float) -> DataFrame:
    bps = bps if isinstance(bps, Column) else F.lit(float(bps))
    return months.withColumn("cost", 2 * F.col("turnover") * bps * 1e-4).withColumn("net_ls", F.col("gross_ls") - F.col("cost"))


def annual_sharpe(x: str, least: int = 6) -> Column:
    """Monthly Sharpe ratio of at least `least` months."""
    return F.when(F.count(x) >= least, sharpe(x, 12.0))


def costed_grid(preds: DataFrame, returns_of, grid: DataFrame, least: int = 30) -> DataFrame:
    """Every cell of grid (delay_days, horizon_days, q, cost_bps) in one job.

    returns_of() gives (ticker, date, delay_days, horizon_days, trade_ret).  Only delay and horizon change outcomes and only
    q changes baskets; costs are algebra on them.
    """
    rows = preds.join(returns_of, ["ticker", "date"]).where(present("pred", "trade_ret"))
    cells = F.broadcast(grid.select("q").distinct())  # the few values of the grid
    cell = ["delay_days", "horizon_days"]
    keys = [*cell, "q"]
    paired = pairs_by_q(rows, cell, cells)
    months = monthly_baskets(rows, cell, "trade_ret", F.col("q"), least, cells)
    costs = F.broadcast(grid.select("cost_bps").distinct())
    by = [*keys, "cost_bps"]
    event = paired.crossJoin(costs).withColumn("net", F.col("ls") - 2 * F.col("cost_bps") * 1e-4).groupBy(*by).agg(F.count("net").alias("n_pairs"), F.avg("net").alias("event_mean_net"), hit_rate("net").alias("event_hit"))
    month = with_costs(months.crossJoin(costs), F.col("cost_bps")).groupBy(*by).agg(annual_sharpe("net_ls").alias("monthly_sharpe_ann"), F.count(F.lit(1)).alias("months"))
    return event.join(month, by, "left").withColumn("months", F.coalesce("months", F.lit(0).cast("bigint")))


def pairs_by_q(rows: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
    """Pairs within keys for each q of cells; places don't depend on q, so rows are placed once and only baskets are copied."""
    rows = ranked_wide(rows, keys).crossJoin(cells).withColumn("k", basket(F.col("q")))
    keys = [*keys, "q"]
    long = rows.where("rn <= k").select(*keys, F.col("rn").alias("i"), F.col("trade_ret").alias("a"))
    short = rows.where("rn > n - k").select(*keys, (F.col("rn") - (F.col("n") - F.col("k"))).alias("i"), F.col("trade_ret").alias("b"))
    return long.join(short, [*keys, "i"]).select(*keys, "i", (F.col("a") - F.col("b")).alias("ls"))
