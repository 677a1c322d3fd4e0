"""Core operators against the SQL oracle, brute force and hand-made cases."""

import datetime as dt
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats as X
from tidemark.operators import cleaning, engine, longshort, models, places, returns, robustness
from tidemark.operators.boosting import Boosting
from tidemark.operators.engine import Scenario
from tidemark.plans.registry import ORACLE, QUERIES, _year_scenarios
from tidemark.sources import tables as S

SF = "/root/testdata/sf0.001"
SOME = ["quantile_ls_gaps", "ls_pairs_gaps", "costed_eventlevel_gaps", "signal_trades_gaps", "ar_panel", "costed_grid", "cv_metrics", "effective_exchange_date", "clean_normalize", "effective_trade_date", "rolling_features", "caar", "bh_fdr", "purged_folds", "quantile_ls_daily", "ls_pairs", "active_book", "vol_target", "engine_summary", "shuffled_labels"]


def cells(rows):
    text = lambda v: "" if v is None or v != v else f"{v + 0.0:.7f}" if isinstance(v, (int, float)) else str(v).removesuffix(" 00:00:00")
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    out = QUERIES[name](spark, SF)
    names = sorted(out.columns)
    rel = db.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLE[name]})").fetchall()
    assert cells(out.select(*[f"`{n}`" for n in names]).collect()) == cells(rel)


CASES = [  # wall clock in New York, bucket, effective date
    ("2024-01-05 16:30:00", "afterhours", "2024-01-08"), ("2024-07-04 08:00:00", "premarket", "2024-07-05"), ("2024-01-03 08:00:00", "premarket", "2024-01-03"),
    ("2024-01-03 10:00:00", "intraday", "2024-01-04"), ("2024-03-10 08:00:00", "premarket", "2024-03-11"), ("2024-01-06 16:30:00", "afterhours", "2024-01-09"),
]


def test_effective_dates(spark):
    df = spark.createDataFrame([(et,) for et, _, _ in CASES], "s string").withColumn("et", F.to_timestamp("s"))
    df = df.withColumn("bucket", X.session_bucket(F.col("et")))
    got = {r.s: (r.bucket, str(r.effective_date)) for r in cleaning.effective_dates(df, cleaning.exchange_calendar(spark, 2024, 2024), "et", "bucket").collect()}
    assert got == {et: (b, d) for et, b, d in CASES}


def test_holidays():
    day = dt.date.fromisoformat
    assert cleaning.exchange_holidays(2024) == set(map(day, ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25"]))
    assert day("2022-01-03") not in cleaning.exchange_holidays(2022) and day("2021-12-31") not in cleaning.exchange_holidays(2021)


def loop(trades, days):
    """The active book day by day."""
    state, out = {}, []
    order = sorted(trades, key=lambda t: (t[1], t[2], t[0], t[4], -t[3], t[5]))
    for day in range(days):
        for t in order:
            if t[2] == day:
                state.pop(t[0], None)
        for t in order:
            if t[1] == day:
                state[t[0]] = t[3]
        out += [(day, k, s) for k, s in state.items()]
    return sorted(out)


def test_active_book_against_loop(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for book in range(25):
        trades = []
        for rn in range(rng.randint(1, 25)):
            entry = rng.randrange(18)
            trades.append((f"T{rng.randrange(4)}", entry, entry + rng.randint(0, 6), rng.choice([1, -1]), dt.date(2024, 1, 1 + rng.randrange(20)), rn))
        trades = [t for t in trades if t[2] < 20]
        want[book] = loop(trades, 20)
        rows += [(book, *t) for t in trades]
    df = spark.createDataFrame(rows, "book_id int, ticker string, entry int, exit int, side int, date date, rn int")
    got = {}
    for r in engine.active_book(df, 20).collect():
        got.setdefault(r.book_id, []).append((r.pos, r.ticker, r.side))
    assert {b: sorted(v) for b, v in got.items()} == {b: v for b, v in want.items() if v}


def test_name_cap_never_binds(spark):
    books = engine.scenario_table(spark, [Scenario(0)])
    one = spark.createDataFrame([(0, 0, "A", 1), (0, 0, "B", -1)], "book_id int, pos int, ticker string, side int")
    assert sorted(r.w for r in engine.weights(one, books).collect()) == [-0.5, 0.5]


def test_folds_drop_first_and_purge(spark):
    dates = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    rows = models.folds(dates).collect()
    assert {r.fold for r in rows} == {1, 2, 3, 4}
    assert max(r.date for r in rows if r.fold == 1 and r.role == "train") == dt.date(2024, 1, 13)


def test_false_discovery_null(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.q, 6) for r in returns.false_discovery(df).collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}
    assert all(r.q is None for r in returns.false_discovery(df.unionByName(spark.createDataFrame([("d", None)], "k string, p double"))).collect())


def test_zero_close_gives_null(spark):
    px = spark.createDataFrame([("A", dt.date(2024, 1, i), c, 1) for i, c in ((1, 1.0), (2, 0.0), (3, 2.0), (4, None))], "ticker string, date date, close double, volume long")
    assert [r.ret for r in returns.with_returns(px).orderBy("date").collect()] == [None, -1.0, None]


def test_bootstrap_of_all_groups(spark):
    rng = random.Random(4)
    rows = [(i, "AB"[i % 2] if i % 50 else "C", None if i % 3 else "open", rng.gauss(0.05, 1), None if i % 7 == 0 else rng.gauss(0, 1)) for i in range(600)]
    cars = spark.createDataFrame(rows, "event_id long, form string, bucket string, x double, y double")
    got = {(r.group, r.split, r.metric): r for r in returns.bootstrap_tests(cars, ["form", "bucket"], ["x", "y"]).collect()}
    assert set(got) == {(g, s, m) for g, s in (("ALL", "ALL"), ("form", "A"), ("form", "B"), ("bucket", "open")) for m in "xy"}
    for (group, split, metric), r in got.items():
        at = {"ALL": None, "form": 1, "bucket": 2}[group]
        x = [v for row in rows if (v := row[3 if metric == "x" else 4]) is not None and (at is None or row[at] == split)]
        mean = sum(x) / len(x)
        means = np.random.default_rng(1).choice(x, (8000, len(x))).mean(1)
        assert r.n == len(x) and abs(r.mean - mean) < 1e-12
        assert abs(r.boot_p * 2000 - round(r.boot_p * 2000)) < 1e-6
        assert abs(r.boot_p - (abs(means) >= abs(mean)).mean()) < 0.035  # three deviations of the 2000 draws


def test_bootstrap_weights():
    w = returns._weights(np.arange(3000), 2000).astype(float)
    assert w.shape == (3000, 2000) and abs(w.mean() - 1) < 2e-3 and abs(w.var() - 1) < 5e-3
    assert abs(np.corrcoef(w[:, :200].T) - np.eye(200)).max() < 0.1 and abs(np.corrcoef(w[:200]) - np.eye(200)).max() < 0.12


def test_market_fits_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    mkt = 5 + 1e-3 * rng.standard_normal(400)
    rows = [(t, i, float(a + b * m + 1e-4 * e), float(m)) for t, a, b in (("A", 1000.0, 2.0), ("B", -1e-3, 0.5)) for i, (m, e) in enumerate(zip(mkt, rng.standard_normal(400)))]
    rows += [("C", i, 0.1 * i, 1.0) for i in range(400)]  # a market that doesn't move has no fit
    joint = spark.createDataFrame(rows, "ticker string, pos int, ret double, mkt double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("pos")))
    got = {(r.ticker, r.pos): r for r in returns.market_fits(joint).collect()}
    ret = {(t, i): y for t, i, y, _ in rows}
    for t in "AB":
        for i in range(120, 400, 7):
            beta, alpha = np.polyfit(mkt[i - 120 : i - 21] - 5, [ret[t, j] for j in range(i - 120, i - 21)], 1)
            assert got[t, i].n_est == 99 and abs(got[t, i].beta - beta) < 1e-6 and abs(got[t, i].alpha + 5 * got[t, i].beta - alpha) < 1e-9
    assert all(got["C", i].beta is None and got["C", i].alpha is None for i in range(400))


def test_bootstrap_reaches_q(spark):
    rows = {(r.group, r.split, r.metric): r for r in QUERIES["event_study_robustness"](spark, SF).collect()}
    assert {("ALL", "ALL", m) for m in ("car_main", "car_pretrend")} <= set(rows)
    tests = sorted((r.boot_p, r.bh_q) for k, r in rows.items() if k[0] != "ALL")
    least = 1.0
    for k in range(len(tests), 0, -1):
        least = min(least, tests[k - 1][0] * len(tests) / k)
        assert abs(tests[k - 1][1] - least) < 1e-5


def test_whole_filings(spark, tmp_path):
    def check(name, folder):
        rows = duckdb.sql(ORACLE[name].replace("FROM orders", f"FROM '{folder}/orders.parquet{'/*.parquet' if os.path.isdir(f'{folder}/orders.parquet') else ''}'")).fetchall()
        got = QUERIES[name](spark, str(folder)).collect()
        assert sorted(map(tuple, got)) == sorted(rows)
        return got

    whole, cut = check("explode_filings_2000", SF), check("explode_filings", SF)
    assert len(whole) == duckdb.sql(f"SELECT count(*) FROM '{SF}/orders.parquet' WHERE o_orderstatus IN ('F', 'O')").fetchall()[0][0] > len(cut)
    # the cap binds for one customer
    spark.range(2600).selectExpr("id as o_orderkey", "if(id % 13 = 0, 2L, 1L) as o_custkey", "array('F', 'O', 'P')[id % 3] as o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    got = check("explode_filings_2000", tmp_path)
    assert {c: sum(r.cik == c for r in got) for c in "12"} == {c: sum(i % 3 < 2 for i in [i for i in range(2600) if (i % 13 == 0) == (c == "2")][:2000]) for c in "12"}


def test_sanity_sets(spark):
    day = lambda i: dt.date(2024, 1, 1 + i % 3)
    rows = [(i, f"T{i % 5}", day(i), i / 60, [None, float("nan"), i / 7][i % 3] if i % 2 else 1.0) for i in range(60)]
    sets = {}
    for r in robustness.sanity_sets(spark.createDataFrame(rows, "event_id long, ticker string, date date, pred double, y_true double")).collect():
        sets.setdefault(r.pred_set, {})[r.event_id] = (r.ticker, r.date, r.pred)
    assert all({i: v[:2] for i, v in s.items()} == {r[0]: r[1:3] for r in rows} for s in sets.values())
    preds = {name: [s[i][2] for i in range(60)] for name, s in sets.items()}
    base, labels = [r[3] for r in rows], [0.0 if r[4] is None or r[4] != r[4] else r[4] for r in rows]
    assert preds["base_oos_pred"] == base
    assert preds["shuffled_labels_proxy"] != labels and sorted(preds["shuffled_labels_proxy"]) == sorted(labels)
    assert preds["within_day_shuffle"] != base and all(sorted(preds["within_day_shuffle"][k::3]) == sorted(base[k::3]) for k in range(3))
    assert len(set(preds["random_predictions"])) == 60


def test_sanity_engine(spark):
    got = {r.variant: r.asDict() for r in QUERIES["sanity_engine"](spark, SF).collect()}
    assert set(got) == {"base_oos_pred", "random_predictions", "shuffled_labels_proxy", "within_day_shuffle"}
    base = next(r.asDict() for r in QUERIES["engine_oos"](spark, SF).collect() if r.scenario_id == 0)
    assert all(got["base_oos_pred"][c] == v for c, v in base.items() if c != "scenario_id")


def test_years_outside_the_list(spark):
    days = spark.range(450).selectExpr("id as event_id", "'A' as ticker", "make_date(if(id < 220, 2024, if(id < 440, 1995, 2023)), 3, 1) as date", "0.5D as pred")
    scenarios = {s.pred_set: s.scenario_id for s in _year_scenarios(robustness.by_year(days))}
    assert scenarios["2024"] == 12 and scenarios["1995"] == 4 and "2023" not in scenarios and len(scenarios) == 13


def events_of_days(spark, per_day):
    rng = random.Random(2)
    rows = []
    for i in range(40 * per_day):
        day = dt.date(2024, 1, 1) + dt.timedelta(i // per_day)
        form, bucket = rng.choice("AB"), rng.choice(["open", "close", "late"])
        rows.append((i, form, bucket, day, rng.gauss(0, 1) + day.weekday() + (bucket == "late"), *(rng.gauss(0, 2) for _ in models.FEATURES), day.weekday(), day.month))
    return rows, spark.createDataFrame(rows, f"event_id long, form string, session_bucket string, trade_date date, y double, {', '.join(c + ' double' for c in models.FEATURES)}, dow long, month long").withColumn("ticker", F.lit("T"))


def test_ridge_against_closed_form(spark):
    rows, data = events_of_days(spark, 20)
    start = dt.date(2024, 1, 21)
    train, test = [r for r in rows if r[3] < start - dt.timedelta(7)], [r for r in rows if r[3] >= start]
    numbers = lambda rs: np.array([r[5:] for r in rs], float)
    mean, sd = numbers(train).mean(0), numbers(train).std(0)
    full = lambda rs: np.hstack([(numbers(rs) - mean) / np.where(sd == 0, 1, sd), np.array([[r[1] == f for f in "AB"] + [r[2] == b for b in ("close", "late", "open")] for r in rs], float)])
    x, y = full(train), np.array([r[4] for r in train])
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 10 * np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean()))
    want = y.mean() + (full(test) - x.mean(0)) @ w
    got = {r.event_id: r.pred for r in models.walk_forward(data, "ridge", splits=2).collect()}
    assert set(got) == {r[0] for r in test}
    assert np.abs(np.array([got[r[0]] for r in test]) - want).max() < 1e-10


def test_boosting_has_no_gate(spark):
    assert Boosting().trees == 600
    rows, data = events_of_days(spark, 2)
    assert {r.event_id for r in models.walk_forward(data, "gbt", splits=2, boosting=Boosting(trees=3)).collect()} == {r[0] for r in rows if r[3] >= dt.date(2024, 1, 21)}


NAN = float("nan")


def test_missing_predictions_never_trade(spark):
    day = dt.date(2024, 1, 2)
    preds = [(1, "A", 0.9), (2, "B", None), (3, "C", NAN), (4, "D", 0.1), (5, "E", 0.5), (6, "F", 0.4), (7, None, 5.0)]
    df = spark.createDataFrame([("base", i, t, day, p) for i, t, p in preds], "pred_set string, event_id long, ticker string, date date, pred double")
    days = spark.createDataFrame([(day + dt.timedelta(i),) for i in range(20)], "date date")
    books = engine.scenario_table(spark, [Scenario(0)]).select("book_id", *engine.BOOK)
    got = {(r.ticker, r.side) for r in engine.signal_trades(df, cleaning.sessions(days), books).collect()}
    assert got == {("A", 1), ("D", -1)}
    rows = df.withColumn("y", F.when(F.col("event_id") == 5, F.lit(NAN)).when(F.col("event_id") == 6, F.lit(None)).otherwise(F.col("event_id").cast("double")))
    for keys in ([], ["date"]):  # 1 and 4 are left, 7 has no ticker but an outcome
        got = [(r.i, r.ls) for r in longshort.pairs(rows, keys, "y", q=0.4).collect()]
        assert got == [(1, 7.0 - 4.0)]


def test_places_and_ranks(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, rng.choice([0.5, rng.random(), -0.0, NAN]) if i % 4 else 0.5) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, k int, x double").where("NOT isnan(x)")
    rows = [r for r in rows if r[2] == r[2]]
    got = {r.event_id: (r._place, r._all) for r in places.placed(df, ["k"], [F.desc("x")], [F.col("event_id")]).collect()}
    ranks = {r.event_id: r.r for r in places.mean_ranks(df, ["k"], "x", "r").collect()}
    for k in range(3):
        own = sorted((-x, i) for i, j, x in rows if j == k)
        assert [got[i] for _, i in own] == [(place, len(own)) for place in range(len(own))]
        for x, i in own:
            assert ranks[i] == sum(-y < -x for y, _ in own) + (sum(y == x for y, _ in own) + 1) / 2
    assert places.placed(df.limit(0), [], [F.desc("x")], [F.col("event_id")]).count() == 0


def test_null_times_and_microseconds(spark):
    df = spark.sql("select * from values (timestamp '2024-01-03 10:00:00', 1), (cast(null as timestamp), 2), (timestamp '2024-01-03 10:00:00.25', 3) as t(et, i)")
    got = {r.i: (r.b, r.iso) for r in df.select("i", X.session_bucket(F.col("et")).alias("b"), X.iso_utc(F.col("et")).alias("iso")).collect()}
    assert got == {1: ("intraday", "2024-01-03T10:00:00+00:00"), 2: (None, None), 3: ("intraday", "2024-01-03T10:00:00.250000+00:00")}


def test_dates_without_sessions(spark):
    assert dt.date(1994, 4, 27) in cleaning.exchange_holidays(1994)
    df = spark.sql("select * from values (timestamp '2024-12-20 08:00:00', 'premarket'), (timestamp '2024-01-02 08:00:00', 'premarket') as t(et, bucket)")
    calendar = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2025, 1, 10),)], "date date")
    got = {str(r.et)[:10]: r.effective_date for r in cleaning.effective_dates(df, cleaning.sessions(calendar), "et", "bucket").collect()}
    assert got == {"2024-01-02": dt.date(2024, 1, 2), "2024-12-20": None}  # 21 days are too many


def test_landed_files(spark, tmp_path):
    (tmp_path / "prices").mkdir()
    (tmp_path / "prices" / "abc.us.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n2024-01-03,1,2,0.5,N/D,100\nbad,1,1,1,1,1\n2024-01-02,9,9,9,9,9\n")
    raw = S.price_csv(spark, str(tmp_path / "prices"))
    got = cleaning.standard_prices(raw, ["open"]).collect()
    assert [(r.ticker, str(r.date), r.close, r.volume) for r in got] == [("ABC", "2024-01-02", 1.5, 100.0)]
    for name, ticker in (("universe_sec_2026-02-09.csv", "old"), ("universe_sec_2026-03-01.csv", "new"), ("sp500_2020.csv", "index")):
        (tmp_path / name).write_text(f'cik,ticker,name,source,asof_date\n1,{ticker},"Name, Inc.",sec,2026-02-09\n')
    paths = [str(tmp_path / n) for n in ("universe_sec_2026-02-09.csv", "universe_sec_2026-03-01.csv", "sp500_2020.csv")]
    assert [S.universe_csv(spark, p).first().ticker for p in (paths, paths[:2])] == ["index", "new"]
    (tmp_path / "company.json").write_text('{"0": {"cik_str": 7, "ticker": "x", "title": "X Corp"}, "1": {"cik_str": 8, "ticker": "y", "title": "Y"}}')
    assert sorted(tuple(r) for r in S.company_json(spark, str(tmp_path / "company.json")).collect()) == [(7, "x", "X Corp"), (8, "y", "Y")]
    (tmp_path / "subs.json").write_text('{"cik": "7", "filings": {"recent": {"form": ["8-K", "4", "10-Q"], "accessionNumber": ["a", "b", "c"], "acceptanceDateTime": ["20240103100000", "nan", "2024-01-03T10:00:00.000Z"]}}}')
    rows = cleaning.filings_of(S.submissions_json(spark, str(tmp_path / "subs.json")), 2000, ["8-K", "10-Q"])
    times = rows.select("form", F.unix_timestamp(X.acceptance_time("accepted")).alias("t")).collect()
    assert {r.form: r.t for r in times} == {"8-K": 1704276000, "10-Q": 1704276000}


def test_sinks_and_choice_of_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    S.write_table(df, f"{tmp_path}/ridge", ["k"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/ridge").select("id", "k").collect())) == [(1, "a"), (2, "b")]
    S.write_report_csv(df, f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 2
    pick = lambda *names: S.first_table(spark, [f"{tmp_path}/{n}" for n in names])
    assert pick("boosted", "ridge").count() == 2 and pick("boosted") is None


def test_logit_against_newton(spark):
    rows, data = events_of_days(spark, 20)
    start = dt.date(2024, 1, 21)
    train, test = [r for r in rows if r[3] < start - dt.timedelta(7)], [r for r in rows if r[3] >= start]
    numbers = lambda rs: np.array([r[5:] for r in rs], float)
    mean, sd = numbers(train).mean(0), numbers(train).std(0)
    full = lambda rs: np.hstack([(numbers(rs) - mean) / np.where(sd == 0, 1, sd), np.array([[r[1] == f for f in "AB"] + [r[2] == b for b in ("close", "late", "open")] for r in rs], float), np.ones((len(rs), 1))])
    x, y = full(train), np.array([r[4] > 0 for r in train], float)
    w, shrink = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.lstsq(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(shrink), x.T @ (p - y) + shrink * w, rcond=None)[0]
    got = {r.event_id: r for r in models.walk_forward(data, "logit", splits=2).collect()}
    assert set(got) == {r[0] for r in test}
    assert np.allclose([got[r[0]].pred for r in test], 1 / (1 + np.exp(-full(test) @ w)), atol=1e-8)
    assert {(r.test_start, r.test_end) for r in got.values()} == {(start, dt.date(2024, 2, 9))} and all(r.date == next(q[3] for q in rows if q[0] == r.event_id) for r in got.values())


def test_random_predictions_are_normal(spark):
    df = spark.range(20000).withColumnRenamed("id", "event_id")
    one, two = (sorted((r.event_id, r.pred) for r in robustness.random_predictions(df).collect()) for _ in range(2))
    x = np.array([p for _, p in one])
    assert one == two and abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs((x < 1).mean() - 0.8413) < 0.01
