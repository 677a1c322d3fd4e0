"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import stats as X
from tidemark.operators import cleaning, engine, longshort, models, returns, robustness
from tidemark.operators.engine import Scenario
from tidemark.plans.oracle import _pairs, _sharpe, rounded, sql
from tidemark.plans.oracle import engine as engine_sql
from tidemark.plans.oracle import ridge as ridge_sql
from tidemark.sources import store
from tidemark.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BASE = [Scenario(0)]
BOTH = [Scenario(0), Scenario(1, vol_target=0.10, vol_lookback=60)]
GRID = [Scenario(i, delay_days=d, horizon_days=h, q=q, cost_bps=c) for i, (d, h, q, c) in enumerate((d, h, q, c) for d in (0, 1) for h in (1, 5, 10) for q in (0.1, 0.2, 0.3) for c in (0.0, 2.0, 5.0, 10.0))]
YEARS = [Scenario(i, pred_set=p) for i, p in enumerate(["ALL", *map(str, range(1992, 2003))])]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def near(df: DataFrame, columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c.strip(): F.round(c.strip(), digits) for c in columns.split(",")})


# Scans, cleaning and dates


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderstatus IN ('F', 'O')")
def scan_filter_project(spark, d):
    return S.table(spark, d, "orders").where("o_orderdate >= date '1998-01-01' and o_orderstatus in ('F', 'O')").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_RAW = """SELECT l_orderkey, l_linenumber, concat(' s', l_suppkey, ' ') AS ticker, CASE WHEN l_linenumber = 7 THEN 'N/D' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS date,
 CASE WHEN l_orderkey % 11 = 0 THEN 'bad' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS close, CAST(CAST(l_quantity AS BIGINT) * 3 AS VARCHAR) AS volume FROM lineitem"""


@query(f"""WITH raw AS ({_RAW}), c AS (SELECT l_orderkey, l_linenumber, upper(trim(ticker)) AS ticker, TRY_CAST(date AS DATE) AS date, TRY_CAST(close AS DOUBLE) AS close, TRY_CAST(volume AS DOUBLE) AS volume FROM raw),
 r AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY l_orderkey, l_linenumber) AS o FROM c WHERE date IS NOT NULL AND close IS NOT NULL)
 SELECT ticker, date, close, volume FROM r WHERE o = 1""")
def clean_normalize(spark, d):
    li = S.table(spark, d, "lineitem")
    quantity = F.col("l_quantity").cast("bigint")
    raw = li.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit(" s"), "l_suppkey", F.lit(" ")).alias("Ticker"), F.when(F.col("l_linenumber") == 7, "N/D").otherwise(F.to_date("l_shipdate").cast("string")).alias("Date"),
        F.when(F.col("l_orderkey") % 11 == 0, "bad").otherwise(quantity.cast("string")).alias("Close"), (quantity * 3).cast("string").alias("Volume"),
    )
    return cleaning.existing(cleaning.standard_prices(raw, ["l_orderkey", "l_linenumber"]), ["ticker", "date", "open", "high", "low", "close", "volume"])


@query(sql("SELECT ticker, trade_date, event_id, form FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY accepted_utc, event_id) AS o FROM fi) WHERE o = 1"))
def dedupe_first(spark, d):
    return cleaning.first_of(S.filings(spark, d), ["ticker", "trade_date"], ["accepted_utc", "event_id"]).select("ticker", "trade_date", "event_id", "form")


@query("SELECT CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 10 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') ELSE CAST(c_custkey AS VARCHAR) END AS cik, upper(trim(c_name)) AS ticker FROM customer ORDER BY upper(trim(c_name)) LIMIT 50")
def topk_universe(spark, d):
    key = S.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), X.ticker_name("c_name").alias("ticker"))
    return key.select(X.zero_filled("k").alias("cik"), "ticker").orderBy("ticker").limit(50)


@query(sql("SELECT DISTINCT ticker FROM fi WHERE ticker IN (SELECT ticker FROM pr) AND ticker <> 'MKT'"))
def semi_join_common(spark, d):
    return cleaning.in_both(S.filings(spark, d), S.prices(spark, d), "ticker", "MKT")


def _bucketed(spark, d):
    et = S.filings(spark, d).withColumn("accepted_et", X.eastern(F.col("accepted_utc")))
    return et.withColumn("session_bucket", X.session_bucket(F.col("accepted_et")))


@query(sql("SELECT event_id, session_bucket, CAST(hour(accepted_et) AS INTEGER) AS hour_et FROM bk"))
def session_bucket(spark, d):
    return _bucketed(spark, d).select("event_id", "session_bucket", F.hour("accepted_et").alias("hour_et"))


@query(sql("SELECT event_id, substr(sha256(concat_ws('|', ticker, form, strftime(accepted_utc, '%Y-%m-%dT%H:%M:%S+00:00'))), 1, 16) AS key FROM fi"))
def event_id_hash(spark, d):
    return S.filings(spark, d).select("event_id", X.event_key(F.col("ticker"), F.col("form"), X.iso_utc(F.col("accepted_utc"))).alias("key"))


@query(sql("SELECT strftime(accepted_utc, '%Y%m%d%H%M%S') AS stamp, event_id, CAST(accepted_utc AS DATE) AS day, CAST(epoch(accepted_utc) AS BIGINT) AS seconds FROM fi WHERE event_id % 3 <> 0 UNION ALL SELECT 'nan', event_id, NULL, NULL FROM fi WHERE event_id % 3 = 0"))
def acceptance_times(spark, d):
    stamp = F.when(F.col("event_id") % 3 == 0, "nan").otherwise(F.date_format("accepted_utc", "yyyyMMddHHmmss"))
    rows = S.filings(spark, d).select(stamp.alias("stamp"), "event_id")
    return rows.select("stamp", "event_id", X.acceptance_time("stamp").alias("t")).select("stamp", "event_id", F.to_date("t").alias("day"), F.unix_timestamp("t").alias("seconds"))


@query(sql("SELECT CAST(pos AS INTEGER) AS pos, date FROM cal"))
def trade_calendar(spark, d):
    return cleaning.sessions(returns.daily_returns(S.prices(spark, d))).select("pos", "date")


def _weekdays(spark, d):
    return cleaning.sessions(S.prices(spark, d).where(F.weekday("date") < 5))


@query(sql("""SELECT x.d, a.date AS session, b.date AS shifted FROM (SELECT DISTINCT trade_date AS d FROM fi) x
 LEFT JOIN cw a ON a.pos = (SELECT min(pos) FROM cw WHERE cw.date >= x.d) LEFT JOIN cw b ON b.pos = a.pos + 3"""))
def map_trade_date(spark, d):
    calendar = _weekdays(spark, d)
    at = cleaning.next_session(S.filings(spark, d).select("trade_date"), calendar)
    to = lambda k, name: calendar.select((F.col("pos") - k).alias("pos"), F.col("date").alias(name))
    return at.join(to(0, "session"), "pos", "left").join(to(3, "shifted"), "pos", "left").select("d", "session", "shifted")


@query(sql("""SELECT event_id, session_bucket, b.date AS effective_date FROM (SELECT *, (SELECT min(pos) FROM cw WHERE cw.date >= CAST(accepted_et AS DATE)) AS base FROM bk) x
 LEFT JOIN cw b ON b.pos = base + CASE WHEN session_bucket = 'premarket' THEN 0 ELSE 1 END"""))
def effective_trade_date(spark, d):
    return cleaning.effective_dates(_bucketed(spark, d), _weekdays(spark, d), "accepted_et", "session_bucket").select("event_id", "session_bucket", "effective_date")


_YEARS = range(1990, 2031)
_CLOSED = ", ".join(f"DATE '{day}'" for y in _YEARS for day in sorted(cleaning.exchange_holidays(y)))
_SESSIONS = [
    ("cx", f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT CAST(t AS DATE) AS date FROM generate_series(TIMESTAMP '{_YEARS[0]}-01-01', TIMESTAMP '{_YEARS[-1]}-12-31', INTERVAL 1 DAY) g(t)) WHERE isodow(date) < 6 AND date NOT IN ({_CLOSED})"),
    ("dx", "SELECT d, min(pos) AS base FROM (SELECT DISTINCT CAST(accepted_et AS DATE) AS d FROM bk) x JOIN cx ON cx.date BETWEEN x.d AND x.d + 14 GROUP BY d"),
]


@query(sql("""SELECT event_id, session_bucket, cx.date AS effective_date FROM bk LEFT JOIN dx ON dx.d = CAST(bk.accepted_et AS DATE)
 LEFT JOIN cx ON cx.pos = dx.base + CASE WHEN session_bucket = 'premarket' THEN 0 ELSE 1 END""", *_SESSIONS))
def effective_exchange_date(spark, d):
    calendar = cleaning.exchange_calendar(spark, _YEARS[0], _YEARS[-1])
    return cleaning.effective_dates(_bucketed(spark, d), calendar, "accepted_et", "session_bucket").select("event_id", "session_bucket", "effective_date")


def _exploded(spark, d, most):
    orders = cleaning.first_rows(S.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", most)
    lists = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("l"))
    text = F.transform("l", lambda x: x["o_orderkey"].cast("string"))
    recent = F.struct(F.transform("l", lambda x: x["o_orderstatus"]).alias("form"), text.alias("accessionNumber"), text.alias("acceptanceDateTime"))
    docs = lists.select(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))
    return cleaning.filings_of(docs, most, ["F", "O"]).select("cik", "form", "accession")


@query("""WITH o AS (SELECT o_custkey, list(struct_pack(k := o_orderkey, f := o_orderstatus) ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
 SELECT cik, x.f AS form, CAST(x.k AS VARCHAR) AS accession FROM (SELECT CAST(o_custkey AS VARCHAR) AS cik, unnest(l[1:5]) AS x FROM o) WHERE x.f IN ('F', 'O')""")
def explode_filings(spark, d):
    return _exploded(spark, d, 5)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS cik, o_orderstatus AS form, CAST(o_orderkey AS VARCHAR) AS accession
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i <= 2000 AND o_orderstatus IN ('F', 'O')""")
def explode_filings_2000(spark, d):
    return _exploded(spark, d, 2000)


# Returns, features and the event study


@query(sql(f"SELECT ticker, date, {rounded('ret')} FROM rt"))
def daily_returns(spark, d):
    return near(returns.daily_returns(_prices(spark, d)).select("ticker", "date", "ret"), "ret")


_FEATURES = "mom_1d, mom_5d, mom_20d, vol_20d, dollar_vol_20d"


@query(sql(f"SELECT ticker, date, {rounded('mom_1d, mom_5d, mom_20d, vol_20d')}, round(dollar_vol_20d, 4) AS dollar_vol_20d FROM ft"))
def rolling_features(spark, d):
    out = returns.rolling_features(_prices(spark, d)).select("ticker", "date", *models.FEATURES)
    return near(near(out, "mom_1d, mom_5d, mom_20d, vol_20d"), "dollar_vol_20d", 4)


@query(sql(f"SELECT ticker, date, {rounded('trade_ret')} FROM tc"))
def trade_return_cc(spark, d):
    return near(returns.trade_returns(_prices(spark, d), 1, 5).select("ticker", "date", "trade_ret"), "trade_ret")


@query(sql("SELECT f.event_id, f.ticker, f.trade_date FROM fi f SEMI JOIN rt ON rt.ticker = f.ticker AND rt.date = f.trade_date"))
def align_events(spark, d):
    return returns.align(S.filings(spark, d), returns.daily_returns(S.prices(spark, d))).select("event_id", "ticker", "trade_date")


@query(sql("SELECT f.ticker, count(*) AS missing FROM fi f ANTI JOIN rt ON rt.ticker = f.ticker AND rt.date = f.trade_date GROUP BY 1"))
def align_missing(spark, d):
    return returns.align(S.filings(spark, d), returns.daily_returns(S.prices(spark, d)), "left_anti").groupBy("ticker").agg(F.count(F.lit(1)).alias("missing"))


def _stage(spark, d, name, tables, make, **kept):
    return store.stage(spark, name, [f"{d}/{t}.parquet" for t in tables], {}, make, **kept)


def _prices(spark, d):
    return _stage(spark, d, "prices", ["lineitem"], lambda: S.prices(spark, d), by="ticker", order=("date",))


def _joint(spark, d):
    return _stage(spark, d, "joint", ["lineitem"], lambda: returns.market_fits(returns.joint_returns(returns.daily_returns(_prices(spark, d)), "MKT")))


def _study(spark, d):
    joint = _joint(spark, d)
    study = _stage(spark, d, "study", ["lineitem", "orders"], lambda: returns.study_events(S.filings(spark, d), joint))
    return study, returns.abnormal_returns(study, joint)


_WINDOWS = {"car_main": (-1, 5), "car_pretrend": (-10, -2), "y": (1, 5)}


@query(sql(f"SELECT event_id, ticker, trade_date, n_est, {rounded('alpha, beta')} FROM st"))
def market_model(spark, d):
    return near(returns.study_events(S.filings(spark, d), _joint(spark, d)).select("event_id", "ticker", "trade_date", "n_est", "alpha", "beta"), "alpha, beta")


@query(sql(f"SELECT event_id, tau, {rounded('ar')} FROM ar"))
def ar_panel(spark, d):
    return near(_study(spark, d)[1], "ar")


@query(sql("SELECT tau, round(avg(ar), 8) AS caar, count(ar) AS n_events FROM ar GROUP BY 1"))
def caar(spark, d):
    return near(returns.mean_by_tau(_study(spark, d)[1]), "caar")


@query(sql(f"SELECT event_id, {rounded('car_main, car_pretrend, y')} FROM ca"))
def event_cars(spark, d):
    return near(returns.event_cars(_study(spark, d)[1], _WINDOWS), "car_main, car_pretrend, y")


def _grouped_cars(spark, d):
    study, ar = _study(spark, d)
    et = study.withColumn("session_bucket", X.session_bucket(X.eastern(F.col("accepted_utc"))))
    return et.select("event_id", "form", "session_bucket").join(returns.event_cars(ar, _WINDOWS), "event_id", "left")


_TESTS = [
    ("cg", "SELECT st.event_id, st.form, bk.session_bucket, ca.car_main, ca.car_pretrend FROM st JOIN bk ON bk.event_id = st.event_id LEFT JOIN ca ON ca.event_id = st.event_id"),
    ("lg", "SELECT form, session_bucket, 'car_main' AS metric, car_main AS x FROM cg UNION ALL SELECT form, session_bucket, 'car_pretrend', car_pretrend FROM cg"),
    ("gs", """SELECT CASE WHEN grouping(form) = 0 THEN 'form' WHEN grouping(session_bucket) = 0 THEN 'session_bucket' ELSE 'ALL' END AS "group",
 CASE WHEN grouping(form) = 0 THEN form WHEN grouping(session_bucket) = 0 THEN session_bucket ELSE 'ALL' END AS split, metric, count(x) AS n, avg(x) AS mean, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS t_stat
 FROM lg GROUP BY GROUPING SETS ((metric), (metric, form), (metric, session_bucket))"""),
    ("tt", """SELECT * FROM gs WHERE "group" = 'ALL' OR n >= 100"""),
]


def _tests(spark, d):
    return returns.subgroup_tests(_grouped_cars(spark, d), ["form", "session_bucket"], ["car_main", "car_pretrend"])


@query(sql("""SELECT "group", split, metric, n, round(mean, 8) AS mean, round(t_stat, 6) AS t_stat FROM tt""", *_TESTS))
def subgroup_tests(spark, d):
    return near(near(_tests(spark, d), "mean"), "t_stat", 6)


@query(sql("""SELECT "group", split, metric, round(p, 6) AS p, round(least(1.0, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q
 FROM (SELECT *, row_number() OVER (ORDER BY p, "group", split, metric) AS k, count(*) OVER () AS n FROM (SELECT "group", split, metric, 1 / (1 + abs(t_stat)) AS p FROM tt WHERE "group" <> 'ALL'))""", *_TESTS))
def bh_fdr(spark, d):
    tests = _tests(spark, d).where("group <> 'ALL'").select("group", "split", "metric", (1 / (1 + F.abs("t_stat"))).alias("p"))
    return near(returns.false_discovery(tests), "p, q", 6)


def _boot(spark, d):
    return returns.bootstrap_tests(_grouped_cars(spark, d), ["form", "session_bucket"], ["car_main", "car_pretrend"])


@query()
def boot_pvalue(spark, d):
    return near(near(_boot(spark, d), "mean", 8), "t_stat, boot_p", 6)


@query()
def event_study_robustness(spark, d):
    tests = S.written(_boot(spark, d), "bootstrap")
    q = returns.false_discovery(tests.where("group <> 'ALL'"), "boot_p").withColumnRenamed("q", "bh_q")
    out = tests.where("group = 'ALL'").unionByName(q, allowMissingColumns=True)
    return near(near(out, "mean", 8), "t_stat, boot_p, bh_q", 6)


# Dataset, folds, metrics and models


def _dataset(spark, d):
    prices = _prices(spark, d)
    study, ar = _study(spark, d)
    study = study.withColumn("session_bucket", X.session_bucket(X.eastern(F.col("accepted_utc"))))
    return models.model_dataset(study, returns.event_cars(ar, {"y": (1, 5)}), returns.rolling_features(prices), ["session_bucket", "pred"])


@query(sql(f"SELECT event_id, ticker, form, trade_date, {rounded('y, mom_1d, mom_5d, mom_20d, vol_20d')}, round(dollar_vol_20d, 4) AS dollar_vol_20d, dow, month FROM md"))
def model_dataset(spark, d):
    return near(near(_dataset(spark, d).drop("session_bucket", "pred"), "y, mom_1d, mom_5d, mom_20d, vol_20d"), "dollar_vol_20d", 4)


@query(sql("SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT form) AS forms, min(trade_date) AS first, max(trade_date) AS last FROM md"))
def dataset_profile(spark, d):
    return _dataset(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("form").alias("forms"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))


@query(sql("SELECT CAST(fold AS INTEGER) AS fold, role, date FROM fo"))
def purged_folds(spark, d):
    study = returns.study_events(S.filings(spark, d), _joint(spark, d))
    return models.folds(study.select(F.col("trade_date").alias("date")))


_METRICS = [
    ("mf", "SELECT md.y, st.pred - 0.5 AS p, fo.fold FROM md JOIN st ON st.event_id = md.event_id JOIN fo ON fo.date = md.trade_date AND fo.role = 'test'"),
    ("mr", "SELECT *, rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rp FROM mf"),
    ("mt", "SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_test, avg((y - p) * (y - p)) AS mse, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2, corr(y, p) AS pearson, corr(ry, rp) AS spearman, avg(CASE WHEN (y > 0) = (p > 0) THEN 1.0 ELSE 0.0 END) AS hit_rate FROM mr GROUP BY 1"),
]


def _fold_metrics(spark, d):
    data = S.written(_dataset(spark, d), "dataset")
    test = models.folds(data.select(F.col("trade_date").alias("date"))).where("role = 'test'").select("fold", F.col("date").alias("trade_date"))
    rows = S.written(data.withColumn("p", F.col("pred") - 0.5).join(F.broadcast(test), "trade_date").select("fold", "y", "p"), "tested")
    return models.regression_metrics(rows, ["fold"], "y", "p")


@query(sql(f"SELECT fold, n_test, {rounded('mse, r2, pearson, spearman, hit_rate', 6)} FROM mt", *_METRICS))
def cv_metrics(spark, d):
    return near(_fold_metrics(spark, d), "mse, r2, pearson, spearman, hit_rate", 6)


@query(sql("SELECT 'hash' AS model, round(avg(mse), 6) AS mse, round(avg(r2), 6) AS r2, round(avg(pearson), 6) AS pearson, round(avg(spearman), 6) AS spearman, round(avg(hit_rate), 6) AS hit_rate, CAST(NULL AS DOUBLE) AS accuracy FROM mt UNION ALL SELECT 'none', NULL, NULL, NULL, NULL, NULL, CAST(1.0 AS DOUBLE)", *_METRICS))
def cv_summary(spark, d):
    one = _fold_metrics(spark, d).withColumn("model", F.lit("hash"))
    two = spark.range(1).select(F.lit("none").alias("model"), F.lit(1.0).alias("accuracy"))
    both = one.unionByName(two, allowMissingColumns=True)
    names = ["mse", "r2", "pearson", "spearman", "hit_rate", "accuracy"]
    return near(both.groupBy("model").agg(*[F.avg(c).alias(c) for c in names]), ", ".join(names), 6)


def _oos(spark, d, model, **options):
    """Out-of-sample predictions of a model, written."""
    return S.written(models.walk_forward(S.written(_dataset(spark, d), "dataset"), model, **options), "out-of-sample")


def _walk(spark, d, model, **options):
    keys = ["fold", "test_start", "test_end"]
    out = _oos(spark, d, model, **options)
    if model == "logit":
        found = models.class_metrics(out.withColumnRenamed("pred", "prob"), keys).withColumn("model", F.lit("logit_sign"))
        return near(found, "accuracy, pos_rate_pred, pos_rate_true", 6)
    return near(models.regression_metrics(out, keys).withColumn("model", F.lit({"gbt": "boosted_trees"}.get(model, model))), "mse, r2, pearson, spearman, hit_rate", 6)


_RIDGE = [
    *ridge_sql(),
    ("orr", "SELECT *, rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY fold ORDER BY pred) + (count(*) OVER (PARTITION BY fold, pred) - 1) / 2.0 AS rp FROM op"),
]


@query(sql("""SELECT CAST(fold AS INTEGER) AS fold, test_start, test_end, count(*) AS n_test, round(avg((y - pred) * (y - pred)), 6) AS mse, round(1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)), 6) AS r2, round(corr(y, pred), 6) AS pearson,
 round(corr(ry, rp), 6) AS spearman, round(avg(CASE WHEN (y > 0) = (pred > 0) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, 'ridge' AS model FROM orr GROUP BY 1, 2, 3""", *_RIDGE))
def cv_ridge(spark, d):
    return _walk(spark, d, "ridge")


@query()
def cv_logit(spark, d):
    return _walk(spark, d, "logit")


@query()
def cv_gbt(spark, d):
    return _walk(spark, d, "gbt")


@query()
def cv_models_summary(spark, d):
    both = _walk(spark, d, "ridge").unionByName(_walk(spark, d, "logit"), allowMissingColumns=True)
    names = ["mse", "r2", "pearson", "spearman", "hit_rate", "accuracy"]
    return near(both.groupBy("model").agg(*[F.avg(c).alias(c) for c in names]), ", ".join(names), 6)


@query(sql("SELECT event_id, ticker, date, round(y, 8) AS y_true, round(pred, 8) AS y_pred_ridge, CAST(fold AS INTEGER) AS fold FROM op", *ridge_sql()))
def oos_predictions(spark, d):
    out = _oos(spark, d, "ridge")
    return near(out.select("event_id", "ticker", "date", F.col("y").alias("y_true"), F.col("pred").alias("y_pred_ridge"), "fold"), "y_true, y_pred_ridge")


# Long and short baskets


@query(sql("""SELECT date, max(n) AS n_events, count(*) FILTER (rn <= k) AS n_long, count(*) FILTER (rn > n - k) AS n_short, round(avg(pred) FILTER (rn <= k), 8) AS mean_pred_long, round(avg(pred) FILTER (rn > n - k), 8) AS mean_pred_short,
 round(avg(y_true) FILTER (rn <= k), 8) AS ret_long, round(avg(y_true) FILTER (rn > n - k), 8) AS ret_short, round(avg(y_true) FILTER (rn <= k) - avg(y_true) FILTER (rn > n - k), 8) AS ret_ls FROM rq GROUP BY 1""", *_pairs("sg", "date", "y_true", 10)))
def quantile_ls_daily(spark, d):
    return near(longshort.quantile_daily(S.signals(spark, d)), "mean_pred_long, mean_pred_short, ret_long, ret_short, ret_ls")


def _outcomes(spark, d):
    study, ar = _study(spark, d)
    cars = returns.event_cars(ar, {"y_true": (1, 5)})
    return study.select("event_id", "ticker", F.col("trade_date").alias("date"), "pred").join(cars, "event_id").withColumn("ym", F.date_format("date", "yyyy-MM"))


_SUMMARY = f"count(ls) AS n, round(avg(ls), 8) AS mean, round(stddev_samp(ls), 8) AS std, round(avg(ls) / (stddev_samp(ls) / sqrt(count(ls))), 6) AS t_stat, round({_sharpe('ls')}, 6) AS sharpe, round(avg(CASE WHEN ls > 0 THEN 1.0 ELSE 0.0 END), 8) AS hit"
_YM = ("ym", "SELECT *, strftime(date, '%Y-%m') AS ym FROM yd")


@query(sql(f"SELECT {_SUMMARY} FROM ls", *_pairs("yd", "", "y_true")))
def ls_pairs(spark, d):
    out = longshort.summary(longshort.pairs(_outcomes(spark, d), [], "y_true"), [])
    return near(near(out, "mean, std, hit"), "t_stat, sharpe", 6)


@query(sql(f"SELECT ym, {_SUMMARY} FROM ls GROUP BY ym", ("yy", _YM[1]), *_pairs("yy", "ym", "y_true", 20)))
def ls_pairs_monthly(spark, d):
    out = longshort.summary(longshort.pairs(_outcomes(spark, d), ["ym"], "y_true", least=20), ["ym"])
    return near(near(out, "mean, std, hit"), "t_stat, sharpe", 6)


def _paid(spark, d):
    prices = _prices(spark, d)
    study = returns.study_events(S.filings(spark, d), _joint(spark, d)).select("event_id", "ticker", F.col("trade_date").alias("date"), "pred")
    return _traded(study, prices)


def _traded(preds, prices):
    trade = returns.trade_returns(prices, 1, 5).select("ticker", "date", "trade_ret")
    return preds.join(trade, ["ticker", "date"])


_EVENTLEVEL = f"""SELECT count(*) AS n_pairs, round(avg(ls), 8) AS mean_gross, round(avg(net), 8) AS mean_net, round(stddev_samp(ls), 8) AS std_gross, round(stddev_samp(net), 8) AS std_net, round({_sharpe('ls')}, 6) AS sharpe_gross, round({_sharpe('net')}, 6) AS sharpe_net,
 round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 8) AS hit_rate, round(CAST(0.0004 AS DOUBLE), 8) AS cost_per_pair FROM (SELECT *, ls - CAST(0.0004 AS DOUBLE) AS net FROM ls)"""


@query(sql(_EVENTLEVEL, *_pairs("pt", "", "trade_ret")))
def costed_eventlevel(spark, d):
    return _costed(_paid(spark, d))


def _costed(paid):
    out = longshort.costed_pairs(longshort.pairs(paid, [], "trade_ret"))
    return near(near(out, "mean_gross, mean_net, std_gross, std_net, hit_rate, cost_per_pair"), "sharpe_gross, sharpe_net", 6)


@query(sql(_EVENTLEVEL, *ridge_sql(), ("po", "SELECT op.event_id, op.pred, tc.trade_ret FROM op JOIN tc ON tc.ticker = op.ticker AND tc.date = op.date WHERE tc.trade_ret IS NOT NULL"), *_pairs("po", "", "trade_ret")))
def costed_eventlevel_oos(spark, d):
    return _costed(_traded(_oos(spark, d, "ridge").select("event_id", "ticker", "date", "pred"), S.prices(spark, d)))


def _months(source: str, keys: str, q: str, prefix: str = "") -> list[tuple[str, str]]:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return [
        ("kr", f"SELECT *, greatest(1, CAST(floor({q} * n) AS BIGINT)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY {k}ym ORDER BY pred DESC, event_id) AS rn, count(*) OVER (PARTITION BY {k}ym) AS n FROM {source}) WHERE n >= 30"),
        ("km", f"SELECT {k}ym, max(n) AS n_events, max(k) AS k, avg(trade_ret) FILTER (rn <= k) - avg(trade_ret) FILTER (rn > n - k) AS gross_ls, list(DISTINCT ticker) FILTER (rn <= k) AS l, list(DISTINCT ticker) FILTER (rn > n - k) AS s FROM kr GROUP BY {k}ym"),
        ("kt", f"SELECT *, CASE WHEN lag(ym) OVER w IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * ((1 - len(list_intersect(l, lag(l) OVER w))::DOUBLE / greatest(1, len(l))) + (1 - len(list_intersect(s, lag(s) OVER w))::DOUBLE / greatest(1, len(s)))) END AS turnover FROM km WINDOW w AS ({part} ORDER BY ym)"),
    ]


@query(sql("SELECT ym, n_events, CAST(k AS INTEGER) AS k, round(gross_ls, 8) AS gross_ls, round(turnover, 8) AS turnover, round(2 * turnover * CAST(2e-4 AS DOUBLE), 8) AS cost, round(gross_ls - 2 * turnover * CAST(2e-4 AS DOUBLE), 8) AS net_ls FROM kt", *_months("pt", "", "CAST(0.2 AS DOUBLE)")))
def costed_monthly(spark, d):
    return near(longshort.with_costs(longshort.monthly_baskets(_paid(spark, d), [], "trade_ret", 0.2), 2.0), "gross_ls, turnover, cost, net_ls")


_CELLS = [(d_, h) for d_ in (0, 1) for h in (1, 5, 10)]
_G = " UNION ALL ".join(f"SELECT ticker, date, {d_} AS delay_days, {h} AS horizon_days, lead(close, {d_ + h}) OVER w / lead(close, {d_}) OVER w - 1 AS trade_ret FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY date)" for d_, h in _CELLS)
_GRID = [
    ("gt", _G),
    ("gp", "SELECT sp.event_id, sp.ticker, sp.date, sp.pred, strftime(sp.date, '%Y-%m') AS ym, gt.delay_days, gt.horizon_days, gt.trade_ret, q FROM sp JOIN gt ON gt.ticker = sp.ticker AND gt.date = sp.date CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE)), (CAST(0.3 AS DOUBLE))) v(q) WHERE gt.trade_ret IS NOT NULL"),
    ("gk", "SELECT *, greatest(1, CAST(floor(q * n) AS BIGINT)) AS k FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY delay_days, horizon_days, q) AS n FROM gp WINDOW w AS (PARTITION BY delay_days, horizon_days, q ORDER BY pred DESC, event_id))"),
    ("gl", "SELECT a.delay_days, a.horizon_days, a.q, a.trade_ret - b.trade_ret AS ls FROM gk a JOIN gk b ON a.delay_days = b.delay_days AND a.horizon_days = b.horizon_days AND a.q = b.q AND a.rn <= a.k AND b.rn > b.n - b.k AND b.rn - (b.n - b.k) = a.rn"),
    ("cb", "SELECT * FROM (VALUES (CAST(0 AS DOUBLE)), (CAST(2 AS DOUBLE)), (CAST(5 AS DOUBLE)), (CAST(10 AS DOUBLE))) v(cost_bps)"),
    ("ge", "SELECT delay_days, horizon_days, q, cost_bps, count(*) AS n_pairs, avg(ls - 2 * cost_bps * CAST(1e-4 AS DOUBLE)) AS event_mean_net, avg(CASE WHEN ls - 2 * cost_bps * CAST(1e-4 AS DOUBLE) > 0 THEN 1.0 ELSE 0.0 END) AS event_hit FROM gl CROSS JOIN cb GROUP BY 1, 2, 3, 4"),
    *_months("gp", "delay_days, horizon_days, q", "q"),
    ("gm", f"SELECT delay_days, horizon_days, q, cost_bps, count(*) AS months, CASE WHEN count(*) >= 6 THEN {_sharpe('net', '12')} END AS monthly_sharpe_ann FROM (SELECT *, gross_ls - 2 * turnover * cost_bps * CAST(1e-4 AS DOUBLE) AS net FROM kt CROSS JOIN cb) GROUP BY 1, 2, 3, 4"),
    ("go", "SELECT ge.delay_days, ge.horizon_days, ge.q, ge.cost_bps, n_pairs, round(event_mean_net, 8) AS event_mean_net, round(event_hit, 8) AS event_hit, round(monthly_sharpe_ann, 6) AS monthly_sharpe_ann, coalesce(months, 0) AS months FROM ge LEFT JOIN gm ON gm.delay_days = ge.delay_days AND gm.horizon_days = ge.horizon_days AND gm.q = ge.q AND gm.cost_bps = ge.cost_bps"),
]


def _grid(spark, d):
    px, by = _prices(spark, d), returns.by_ticker()
    study = S.written(returns.study_events(S.filings(spark, d), _joint(spark, d)).select("event_id", "ticker", F.col("trade_date").alias("date"), "pred"), "study")
    cells = [F.struct(F.lit(a).alias("delay_days"), F.lit(h).alias("horizon_days"), (F.try_divide(F.lead("close", a + h).over(by), F.lead("close", a).over(by)) - 1).alias("trade_ret")) for a, h in _CELLS]
    trade = px.select("ticker", "date", F.array(*cells).alias("c")).select("ticker", "date", F.explode("c").alias("c")).select("ticker", "date", "c.*")
    grid = spark.createDataFrame([(a, h, q, c) for a, h in _CELLS for q in (0.1, 0.2, 0.3) for c in (0.0, 2.0, 5.0, 10.0)], "delay_days int, horizon_days int, q double, cost_bps double")
    return near(near(longshort.costed_grid(study, trade, grid), "event_mean_net, event_hit"), "monthly_sharpe_ann", 6)


@query(sql("SELECT * FROM go", *_GRID))
def costed_grid(spark, d):
    return _grid(spark, d)


@query(sql("SELECT * FROM go ORDER BY monthly_sharpe_ann DESC NULLS LAST, delay_days, horizon_days, q, cost_bps LIMIT 10", *_GRID))
def grid_top10(spark, d):
    return _grid(spark, d).orderBy(F.desc_nulls_last("monthly_sharpe_ann"), "delay_days", "horizon_days", "q", "cost_bps").limit(10)


# The same with predictions and outcomes that are missing

_GAPS = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE pred END AS pred"
_KNOWN = "pred IS NOT NULL AND NOT isnan(pred)"


def _gaps(df, names):
    key = F.col("event_id")
    return df.withColumns({c: F.when(key % m == 0, F.lit(None).cast("double")).when(key % n == 0, F.lit(float("nan"))).otherwise(F.col(c)) for c, m, n in names})


@query(sql("""SELECT date, max(n) AS n_events, round(avg(pred) FILTER (rn <= k), 8) AS mean_pred_long, round(avg(y_true) FILTER (rn <= k) - avg(y_true) FILTER (rn > n - k), 8) AS ret_ls FROM rq GROUP BY 1""",
 ("sn", f"SELECT event_id, date, y_true, {_GAPS} FROM sg WHERE event_id % 13 <> 0"), ("sk1", f"SELECT * FROM sn WHERE {_KNOWN}"), *_pairs("sk1", "date", "y_true", 10)))
def quantile_ls_gaps(spark, d):
    rows = _gaps(_gaps(S.signals(spark, d), [("pred", 7, 11)]), [("y_true", 13, 13)])
    return near(longshort.quantile_daily(rows).select("date", "n_events", "mean_pred_long", "ret_ls"), "mean_pred_long, ret_ls")


@query(sql(f"SELECT {_SUMMARY} FROM ls", ("yn", f"SELECT event_id, y_true, {_GAPS} FROM yd WHERE event_id % 13 <> 0 AND event_id % 17 <> 0"), ("yk", f"SELECT * FROM yn WHERE {_KNOWN}"), *_pairs("yk", "", "y_true")))
def ls_pairs_gaps(spark, d):
    rows = _gaps(_outcomes(spark, d), [("pred", 7, 11), ("y_true", 13, 17)])
    out = longshort.summary(longshort.pairs(rows, [], "y_true"), [])
    return near(near(out, "mean, std, hit"), "t_stat, sharpe", 6)


@query(sql("SELECT count(*) AS n_pairs, round(avg(ls), 8) AS mean_gross FROM ls", ("pn", f"SELECT event_id, trade_ret, {_GAPS} FROM pt"), ("pk", f"SELECT * FROM pn WHERE {_KNOWN}"), *_pairs("pk", "", "trade_ret")))
def costed_eventlevel_gaps(spark, d):
    return _costed(_gaps(_paid(spark, d), [("pred", 7, 11)])).select("n_pairs", "mean_gross")


# Portfolio engine


def _engine_inputs(spark, d):
    rets = S.written(returns.daily_returns(S.prices(spark, d)), "returns")
    joint = S.written(returns.market_fits(returns.joint_returns(rets, "MKT")), "joint")
    preds = returns.study_events(S.filings(spark, d), joint).select(F.lit("base").alias("pred_set"), "event_id", "ticker", F.col("trade_date").alias("date"), "pred")
    return rets, S.written(preds, "predictions")


def _book(spark, d):
    rets, preds = _engine_inputs(spark, d)
    books = engine.scenario_table(spark, BASE).select("book_id", *engine.BOOK)
    calendar = cleaning.sessions(rets)
    return rets, calendar, books, engine.signal_trades(preds, calendar, books)


@query(sql("SELECT ticker, CAST(entry AS INTEGER) AS entry, CAST(leave AS INTEGER) AS exit, CAST(side AS INTEGER) AS side, date FROM tr", *engine_sql("sp", BASE)))
def signal_trades(spark, d):
    return _book(spark, d)[3].select("ticker", "entry", "exit", "side", "date")


@query(sql("SELECT ticker, CAST(entry AS INTEGER) AS entry, CAST(leave AS INTEGER) AS exit, CAST(side AS INTEGER) AS side, date FROM tr", ("spn", f"SELECT pred_set, event_id, ticker, date, {_GAPS} FROM sp"), ("spk", f"SELECT * FROM spn WHERE {_KNOWN}"), *engine_sql("spk", BASE)))
def signal_trades_gaps(spark, d):
    rets, preds = _engine_inputs(spark, d)
    books = engine.scenario_table(spark, BASE).select("book_id", *engine.BOOK)
    return engine.signal_trades(_gaps(preds, [("pred", 7, 11)]), cleaning.sessions(rets), books).select("ticker", "entry", "exit", "side", "date")


def _active(spark, d):
    rets, calendar, books, trades = _book(spark, d)
    return rets, calendar, books, engine.active_book(trades, calendar.agg(F.count(F.lit(1)).cast("int").alias("days")))


@query(sql("SELECT CAST(pos AS INTEGER) AS pos, ticker, CAST(side AS INTEGER) AS side FROM ac", *engine_sql("sp", BASE)))
def active_book(spark, d):
    return _active(spark, d)[3].select("pos", "ticker", "side")


TIGHT = [Scenario(0, max_positions=3)]


@query(sql("SELECT CAST(pos AS INTEGER) AS pos, ticker, CAST(side AS INTEGER) AS side FROM lm", *engine_sql("sp", TIGHT)))
def position_limit(spark, d):
    _, _, _, active = _active(spark, d)
    return engine.limited(active, engine.scenario_table(spark, TIGHT)).select("pos", "ticker", "side")


@query(sql(f"SELECT CAST(pos AS INTEGER) AS pos, ticker, {rounded('raw, capped, w')} FROM wt", *engine_sql("sp", BASE)))
def name_cap(spark, d):
    _, _, books, active = _active(spark, d)
    return near(engine.weights(engine.limited(active, books), books).select("pos", "ticker", "raw", "capped", "w"), "raw, capped, w")


_DAILY = "gross_exposure, turnover, cost, lev, ret_gross, ret_net, equity_gross, equity_net"


def _daily(spark, d, scenarios):
    rets, preds = _engine_inputs(spark, d)
    return engine.backtest(rets, preds, engine.scenario_table(spark, scenarios))


_DAY_SQL = f"SELECT date, CAST(n_active AS BIGINT) AS n_active, CAST(n_long AS BIGINT) AS n_long, CAST(n_short AS BIGINT) AS n_short, {rounded(_DAILY)} FROM eq"


@query(sql(_DAY_SQL, *engine_sql("sp", BASE)))
def engine_daily(spark, d):
    return near(_daily(spark, d, BASE).drop("scenario_id"), _DAILY)


@query(sql(_DAY_SQL + " WHERE sid = 1", *engine_sql("sp", BOTH)))
def vol_target(spark, d):
    return near(_daily(spark, d, [BOTH[1]]).drop("scenario_id"), _DAILY)


_SUM = "maxdd_gross, maxdd_net, mean_turnover, mean_cost, avg_active, avg_long, avg_short"
_SUM_SQL = f"SELECT scenario_id, days, {rounded('sharpe_gross, sharpe_net', 6)}, {rounded(_SUM)} FROM sm"


def _summary(daily):
    return near(near(engine.summary(daily), "sharpe_gross, sharpe_net", 6), _SUM)


@query(sql(_SUM_SQL, *engine_sql("sp", BOTH)))
def engine_summary(spark, d):
    return _summary(_daily(spark, d, BOTH))


_EXTRA = "avg_gross_exposure, avg_lev, p95_lev, cost_share"


@query(sql("SELECT sid AS scenario_id, round(avg(gross_exposure), 8) AS avg_gross_exposure, round(avg(lev), 8) AS avg_lev, round(quantile_cont(lev, 0.95), 8) AS p95_lev, round(sum(cost) / nullif(sum(abs(ret_gross)), 0), 8) AS cost_share FROM eq GROUP BY 1", *engine_sql("sp", BOTH)))
def engine_extras(spark, d):
    return near(engine.extras(_daily(spark, d, BOTH)), _EXTRA)


@query(sql(f"SELECT 'engine' AS variant, scenario_id, round(sharpe_net, 6) AS sharpe_net, CAST(NULL AS DOUBLE) AS avg_lev FROM sm UNION ALL SELECT 'extras', sid, NULL, round(avg(lev), 8) FROM eq GROUP BY sid", *engine_sql("sp", BOTH)))
def backtest_summary_union(spark, d):
    daily = _daily(spark, d, BOTH)
    one = near(engine.summary(daily), "sharpe_net", 6).select(F.lit("engine").alias("variant"), "scenario_id", "sharpe_net")
    two = near(engine.extras(daily), "avg_lev").select(F.lit("extras").alias("variant"), "scenario_id", "avg_lev")
    return one.unionByName(two, allowMissingColumns=True)


@query(sql(_SUM_SQL, *engine_sql("sp", GRID)))
def engine_grid(spark, d):
    return _summary(_daily(spark, d, GRID))


def _oos_inputs(spark, d):
    """Daily returns, and ridge's out-of-sample predictions with their outcomes."""
    rets = S.written(returns.daily_returns(S.prices(spark, d)), "returns")
    return rets, _oos(spark, d, "ridge").select(F.lit("base").alias("pred_set"), "event_id", "ticker", "date", "pred", F.col("y").alias("y_true"))


def _oos_summary(spark, d, scenarios):
    rets, preds = _oos_inputs(spark, d)
    return _summary(engine.backtest(rets, preds, engine.scenario_table(spark, scenarios)))


@query(sql(_SUM_SQL, *ridge_sql(), *engine_sql("spo", BOTH)))
def engine_oos(spark, d):
    return _oos_summary(spark, d, BOTH)


@query(sql(_SUM_SQL, *ridge_sql(), *engine_sql("spo", GRID)))
def engine_grid_oos(spark, d):
    return _oos_summary(spark, d, GRID)


_REPORT = """SELECT CASE sm.scenario_id WHEN 0 THEN 'engine' ELSE 'engine_vt10' END AS variant, days, round(sharpe_gross, 6) AS sharpe_gross, round(sharpe_net, 6) AS sharpe_net, round(maxdd_gross, 8) AS maxdd_gross, round(maxdd_net, 8) AS maxdd_net,
 round(mean_turnover, 8) AS mean_turnover, round(mean_cost, 8) AS mean_cost, round(avg_active, 8) AS avg_active, round(avg_long, 8) AS avg_long, round(avg_short, 8) AS avg_short,
 round(ex.avg_gross_exposure, 8) AS avg_gross_exposure, round(ex.avg_lev, 8) AS avg_lev, round(ex.cost_share, 8) AS cost_share_of_gross_abs, CAST(NULL AS BIGINT) AS n_pairs, CAST(NULL AS DOUBLE) AS mean_net, CAST(NULL AS DOUBLE) AS hit_rate
 FROM sm JOIN ex ON ex.sid = sm.scenario_id
 UNION ALL SELECT 'costed_eventlevel', NULL, round({gross}, 6), round({net}, 6), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), round(avg(net), 8), round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 8) FROM (SELECT *, ls - CAST(0.0004 AS DOUBLE) AS net FROM ls)""".format(gross=_sharpe("ls"), net=_sharpe("net"))
_EX = ("ex", "SELECT sid, avg(gross_exposure) AS avg_gross_exposure, avg(lev) AS avg_lev, sum(cost) / nullif(sum(abs(ret_gross)), 0) AS cost_share FROM eq GROUP BY 1")


@query(sql(_REPORT, *engine_sql("sp", BOTH), _EX, *_pairs("pt", "", "trade_ret")))
def backtest_report(spark, d):
    daily = S.written(_daily(spark, d, BOTH), "daily")
    name = F.when(F.col("scenario_id") == 0, "engine").otherwise("engine_vt10").alias("variant")
    extra = near(engine.extras(daily).withColumnRenamed("cost_share", "cost_share_of_gross_abs").drop("p95_lev"), "avg_gross_exposure, avg_lev, cost_share_of_gross_abs")
    books = _summary(daily).join(extra, "scenario_id").select(name, "*").drop("scenario_id")
    pairs = costed_eventlevel(spark, d).select(F.lit("costed_eventlevel").alias("variant"), "sharpe_gross", "sharpe_net", "n_pairs", "mean_net", "hit_rate")
    return books.unionByName(pairs, allowMissingColumns=True)


@query(sql("SELECT date, round(max(ret) FILTER (ticker = 'MKT'), 8) AS MKT, round(max(ret) FILTER (ticker = 'S1'), 8) AS S1, round(max(ret) FILTER (ticker = 'S2'), 8) AS S2 FROM rt GROUP BY 1"))
def returns_pivot(spark, d):
    out = returns.daily_returns(S.prices(spark, d)).groupBy("date").pivot("ticker", ["MKT", "S1", "S2"]).agg(F.first("ret"))
    return near(out, "MKT, S1, S2")


# Robustness

_SHUFFLE = "SELECT a.event_id, round(b.x, 8) AS {c} FROM (SELECT *, row_number() OVER ({p} ORDER BY event_id) AS i FROM {t}) a JOIN (SELECT {c} AS x, {k} row_number() OVER ({p} ORDER BY md5(concat(event_id, '|42')), event_id) AS i FROM {t}) b ON a.i = b.i {on}"


@query(sql(_SHUFFLE.format(c="pred", p="PARTITION BY date", k="date,", t="sg", on="AND a.date = b.date")))
def within_day_shuffle(spark, d):
    return near(robustness.shuffled(S.signals(spark, d), ["date"], "pred").select("event_id", "pred"), "pred")


@query(sql(_SHUFFLE.format(c="y_true", p="", k="", t="sg", on="")))
def shuffled_labels(spark, d):
    return near(robustness.shuffled(S.signals(spark, d), [], "y_true").select("event_id", "y_true"), "y_true")


def _year_scenarios(sets):
    """YEARS, and after them every other set there is: one for each year at most."""
    found = {r.pred_set for r in sets.select("pred_set").where("pred_set is not null").distinct().collect()}
    return YEARS + [Scenario(len(YEARS) + i, pred_set=p) for i, p in enumerate(sorted(found - {s.pred_set for s in YEARS}))]


def _years(source):
    return [("yr", f"SELECT *, CAST(year(date) AS VARCHAR) AS y, count(*) OVER (PARTITION BY year(date)) AS c FROM {source}"), ("ys", "SELECT 'ALL' AS pred_set, event_id, ticker, date, pred FROM yr UNION ALL SELECT y, event_id, ticker, date, pred FROM yr WHERE c >= 200"), *engine_sql("ys", YEARS)]


def _by_year(spark, rets, preds):
    sets = S.written(robustness.by_year(preds), "years")
    return _summary(engine.backtest(rets, sets, engine.scenario_table(spark, _year_scenarios(sets))))


@query(sql(_SUM_SQL + " WHERE days > 0", *_years("sp")))
def subsample_engine(spark, d):
    return _by_year(spark, *_engine_inputs(spark, d))


@query(sql(_SUM_SQL + " WHERE days > 0", *ridge_sql(), ("spy", "SELECT event_id, ticker, date, pred FROM op"), *_years("spy")))
def subsample_engine_oos(spark, d):
    return _by_year(spark, *_oos_inputs(spark, d))


@query()
def random_predictions(spark, d):
    return near(robustness.random_predictions(S.signals(spark, d)).select("event_id", "pred"), "pred")


SANITY = [Scenario(i, pred_set=p) for i, p in enumerate(("base_oos_pred", "random_predictions", "shuffled_labels_proxy", "within_day_shuffle"))]


def _sanity_preds(spark, d):
    rets, preds = _oos_inputs(spark, d)
    return rets, S.written(preds.drop("pred_set"), "sanity")


@query()
def sanity_engine(spark, d):
    rets, preds = _sanity_preds(spark, d)
    scenarios = engine.scenario_table(spark, SANITY)
    out = _summary(engine.backtest(rets, S.written(robustness.sanity_sets(preds), "sanity-sets"), scenarios))
    names = F.broadcast(scenarios.select("scenario_id", F.col("pred_set").alias("variant")))  # four rows
    return out.join(names, "scenario_id").select("variant", *[c for c in out.columns if c != "scenario_id"])
