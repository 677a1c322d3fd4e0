"""The registered queries in DuckDB SQL, built from shared common table expressions."""

from __future__ import annotations

from tidemark.operators.engine import Scenario

CTE = {
    "li": """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c, sum(CAST(l_quantity AS BIGINT)) AS v
 FROM lineitem GROUP BY 1, 2""",
    "pr": """SELECT concat('S', l_suppkey) AS ticker, d AS date, CAST(1000 AS DOUBLE) + sqrt(CAST(c AS DOUBLE) / (CAST(100 AS DOUBLE) * CAST(v AS DOUBLE))) AS close, CAST(v AS BIGINT) AS volume FROM li
 UNION ALL SELECT 'MKT', d, CAST(1000 AS DOUBLE) + sqrt(CAST(sum(c) AS DOUBLE) / (CAST(100 AS DOUBLE) * CAST(sum(v) AS DOUBLE))), CAST(sum(v) AS BIGINT) FROM li GROUP BY d""",
    "sk": "SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1",
    "fi": """SELECT o_orderkey AS event_id, concat('S', sk) AS ticker, o_orderstatus AS form, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS accepted_utc, CAST(o_orderdate AS DATE) AS trade_date,
 CAST((o_orderkey * 2654435761) % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE) AS pred FROM orders JOIN sk ON l_orderkey = o_orderkey""",
    "sg": """SELECT event_id, concat('U', user_id) AS ticker, CAST(ts AS DATE) AS date, CAST((event_id * 2654435761) % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE) AS pred, value AS y_true FROM events""",
    "rt0": "SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM pr",
    "rt": "SELECT * FROM rt0 WHERE ret IS NOT NULL",
    "ft": """SELECT ticker, date, lag(ret) OVER w AS mom_1d,
 CASE WHEN count(ret) OVER w5 = 5 THEN product(1 + ret) OVER w5 - 1 END AS mom_5d, CASE WHEN count(ret) OVER w20 = 20 THEN product(1 + ret) OVER w20 - 1 END AS mom_20d,
 CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS vol_20d, CASE WHEN count(close) OVER w20 = 20 THEN avg(close * volume) OVER w20 END AS dollar_vol_20d
 FROM rt0 WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "jt": "SELECT r.ticker, r.date, r.ret, m.ret AS mkt FROM rt r JOIN rt m ON m.ticker = 'MKT' AND m.date = r.date WHERE r.ticker <> 'MKT'",
    "mm": """SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n, regr_intercept(ret, mkt) OVER e AS alpha, regr_slope(ret, mkt) OVER e AS beta, count(ret) OVER e AS n_est
 FROM jt WINDOW w AS (PARTITION BY ticker ORDER BY date), e AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 120 PRECEDING AND 22 PRECEDING)""",
    "st": "SELECT f.*, pos, n, alpha, beta, n_est FROM fi f JOIN mm ON f.ticker = mm.ticker AND f.trade_date = mm.date WHERE pos >= 120 AND pos + 5 < n",
    "ar": "SELECT event_id, CAST(tau AS INTEGER) AS tau, m.ret - (st.alpha + st.beta * m.mkt) AS ar FROM (SELECT event_id, ticker, alpha, beta, pos, unnest(generate_series(-10, 5)) AS tau FROM st) st JOIN mm m ON m.ticker = st.ticker AND m.pos = st.pos + st.tau",
    "ca": """SELECT event_id, sum(ar ORDER BY tau) FILTER (tau BETWEEN -1 AND 5) AS car_main, sum(ar ORDER BY tau) FILTER (tau BETWEEN -10 AND -2) AS car_pretrend, sum(ar ORDER BY tau) FILTER (tau BETWEEN 1 AND 5) AS y FROM ar GROUP BY 1""",
    "et": "SELECT *, timezone('America/New_York', timezone('UTC', accepted_utc)) AS accepted_et FROM fi",
    "bk": "SELECT *, CASE WHEN hour(accepted_et) * 60 + minute(accepted_et) < 570 THEN 'premarket' WHEN hour(accepted_et) * 60 + minute(accepted_et) >= 960 THEN 'afterhours' ELSE 'intraday' END AS session_bucket FROM et",
    "cw": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM pr WHERE isodow(date) < 6)",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM rt)",
    "sp": "SELECT 'base' AS pred_set, event_id, ticker, trade_date AS date, pred FROM st",
    "md": """SELECT st.event_id, st.ticker, st.form, st.trade_date, ca.y, mom_1d, mom_5d, mom_20d, vol_20d, dollar_vol_20d, isodow(st.trade_date) - 1 AS dow, month(st.trade_date) AS month
 FROM st JOIN ca ON st.event_id = ca.event_id LEFT JOIN ft ON ft.ticker = st.ticker AND ft.date = st.trade_date
 WHERE mom_1d IS NOT NULL AND mom_5d IS NOT NULL AND mom_20d IS NOT NULL AND vol_20d IS NOT NULL AND dollar_vol_20d IS NOT NULL""",
    "yd": "SELECT st.event_id, st.ticker, st.trade_date AS date, st.pred, ca.y AS y_true FROM st JOIN ca ON st.event_id = ca.event_id",
    "tc": "SELECT ticker, date, lead(close, 6) OVER w / lead(close, 1) OVER w - 1 AS trade_ret FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "pt": "SELECT sp.*, strftime(sp.date, '%Y-%m') AS ym, tc.trade_ret FROM sp JOIN tc ON tc.ticker = sp.ticker AND tc.date = sp.date WHERE tc.trade_ret IS NOT NULL",
    "fo": """SELECT 'f' AS x, fold, CASE r WHEN 1 THEN 'train' ELSE 'test' END AS role, date FROM (
 SELECT b.fold, 1 AS r, d.date FROM (SELECT fold, min(date) AS s FROM fd GROUP BY 1) b JOIN fd d ON d.date < b.s - 7
 UNION ALL SELECT fd.fold, 2, fd.date FROM fd WHERE fold IN (SELECT b.fold FROM (SELECT fold, min(date) AS s FROM fd GROUP BY 1) b JOIN fd d ON d.date < b.s - 7))""",
    "fd": "SELECT date, ntile(5) OVER (ORDER BY date) - 1 AS fold FROM (SELECT DISTINCT trade_date AS date FROM st)",
}
ORDER = ["li", "pr", "sk", "fi", "sg", "rt0", "rt", "ft", "jt", "mm", "st", "ar", "ca", "et", "bk", "cw", "cal", "sp", "md", "yd", "tc", "pt", "fd", "fo"]


_KEPT = ("rt", "mm", "st", "ar", "db", "xl", "tn", "tz", "mo", "zc", "ax", "op")


def sql(final: str, *extra: tuple[str, str]) -> str:
    """final with those expressions that it needs, directly or through others."""
    import re

    parts = {**CTE, **dict(extra)}
    names = [*ORDER, *(n for n, _ in extra)]
    need, todo = set(), [final]
    while todo:
        text = todo.pop()
        for n in names:
            if n not in need and re.search(rf"\b(FROM|JOIN|IN \(FROM)\s+{n}\b", text):
                need.add(n)
                todo.append(parts[n])
    held = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in _KEPT else ''}({parts[n]})" for n in names if n in need)
    return (f"WITH {'RECURSIVE ' if 'gj' in need else ''}{held}\n" if held else "") + final


_NUMBERS = ["mom_1d", "mom_5d", "mom_20d", "vol_20d", "dollar_vol_20d", "dow", "month"]
_VALUES = [("form", "FOP"), ("session_bucket", ("afterhours", "intraday", "premarket"))]


def ridge(alpha: float = 10.0) -> list[tuple[str, str]]:
    """op, the out-of-sample predictions: normal equations of scaled features by fold, solved by eliminating a column at a time."""
    x = [f"CAST({c} AS DOUBLE)" for c in _NUMBERS] + [f"CAST(CAST({c} = '{v}' AS INTEGER) AS DOUBLE)" for c, values in _VALUES for v in values]
    p, k = len(x), len(_NUMBERS)
    return [
        ("db", "SELECT md.*, bk.session_bucket FROM md JOIN bk ON bk.event_id = md.event_id"),
        ("xl", f"SELECT event_id, unnest(range(1, {p + 1})) AS i, unnest([{', '.join(x)}]) AS x FROM db"),
        ("tn", "SELECT fo.fold, db.event_id, db.y FROM db JOIN fo ON fo.date = db.trade_date AND fo.role = 'train'"),
        ("tz", "SELECT fo.fold, db.event_id, db.ticker, db.trade_date AS date, db.y FROM db JOIN fo ON fo.date = db.trade_date AND fo.role = 'test'"),
        ("ok", "SELECT a.fold, a.yb, b.test_start, b.test_end FROM (SELECT fold, count(*) AS n, avg(y) AS yb FROM tn GROUP BY 1) a JOIN (SELECT fold, count(*) AS n, min(date) AS test_start, max(date) AS test_end FROM tz GROUP BY 1) b ON a.fold = b.fold WHERE a.n >= 200 AND b.n >= 50"),
        ("mo", f"SELECT tn.fold, xl.i, avg(x) AS m, CASE WHEN i <= {k} AND stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0::DOUBLE END AS s FROM tn JOIN xl ON xl.event_id = tn.event_id GROUP BY 1, 2"),
        ("zc", "SELECT tn.fold, tn.event_id, xl.i, (x - m) / s AS z, y - yb AS v FROM tn JOIN xl ON xl.event_id = tn.event_id JOIN mo ON mo.fold = tn.fold AND mo.i = xl.i JOIN ok ON ok.fold = tn.fold"),
        ("gm", f"SELECT a.fold, a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN {alpha} ELSE 0 END AS v FROM zc a JOIN zc b ON a.fold = b.fold AND a.event_id = b.event_id GROUP BY 1, 2, 3"),
        ("rh", f"SELECT fold, i, {p + 1} AS j, sum(z * v) AS v FROM zc GROUP BY 1, 2"),
        ("ax", "SELECT fold, list(r ORDER BY i) AS m FROM (SELECT fold, i, list(v ORDER BY j) AS r FROM (SELECT * FROM gm UNION ALL SELECT * FROM rh) GROUP BY 1, 2) GROUP BY 1"),
        ("gj", f"SELECT fold, 1 AS k, m FROM ax UNION ALL SELECT fold, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda e: e / r[k]) ELSE list_transform(r, lambda e, j: e - r[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= {p}"),
        ("ws", f"SELECT fold, unnest(range(1, {p + 1})) AS i, unnest(list_transform(m, lambda r: r[{p + 1}])) AS w FROM gj WHERE k = {p + 1}"),
        ("op", """SELECT tz.event_id, tz.ticker, tz.date, tz.fold, tz.y, ok.test_start, ok.test_end, ok.yb + sum(w * (x - m) / s ORDER BY xl.i) AS pred FROM tz JOIN ok ON ok.fold = tz.fold JOIN xl ON xl.event_id = tz.event_id
 JOIN mo ON mo.fold = tz.fold AND mo.i = xl.i JOIN ws ON ws.fold = tz.fold AND ws.i = xl.i GROUP BY tz.event_id, tz.ticker, tz.date, tz.fold, tz.y, ok.test_start, ok.test_end, ok.yb"""),
        ("spo", "SELECT 'base' AS pred_set, event_id, ticker, date, pred FROM op"),
    ]


def _pairs(source: str, keys: str, y: str, least: int = 1, q: float = 0.2) -> list[tuple[str, str]]:
    by = f"PARTITION BY {keys}" if keys else ""
    k = f", {keys}" if keys else ""
    on = "".join(f" AND a.{c.strip()} = b.{c.strip()}" for c in keys.split(",") if c.strip())
    return [
        ("rk", f"SELECT * FROM (SELECT *, row_number() OVER ({by} ORDER BY pred DESC, event_id) AS rn, count(*) OVER ({by}) AS n FROM {source}) WHERE n >= {least}"),
        ("rq", f"SELECT *, greatest(1, CAST(floor(CAST({q} AS DOUBLE) * n) AS BIGINT)) AS k FROM rk"),
        ("ls", f"SELECT a.rn AS i{''.join(f', a.{c.strip()}' for c in keys.split(',') if c.strip())}, a.{y} - b.{y} AS ls FROM rq a JOIN rq b ON a.rn <= a.k AND b.rn > b.n - b.k AND b.rn - (b.n - b.k) = a.rn{on}"),
    ]


def _sharpe(x: str, periods: str = "252") -> str:
    return f"CASE WHEN count({x}) >= 2 AND stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) * sqrt(CAST({periods} AS DOUBLE)) END"


def engine(preds: str, scenarios: list[Scenario]) -> list[tuple[str, str]]:
    """The backtest with one dense row for each scenario, ticker and day."""
    null = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x} AS DOUBLE)"
    values = ", ".join(f"({s.scenario_id}, '{s.pred_set}', {null(s.q)}, {s.delay_days}, {s.horizon_days}, {null(s.cost_bps)}, {s.max_positions}, {null(s.name_cap)}, {null(s.gross_target)}, {null(s.vol_target)}, {s.vol_lookback}, {s.min_positions})" for s in scenarios)
    looks = sorted({s.vol_lookback for s in scenarios if s.vol_target is not None})
    lever = " ".join(f"WHEN vol_target IS NOT NULL AND lookback = {x} THEN CASE WHEN count(n0) OVER w{x} >= {x} AND stddev_samp(n0) OVER w{x} > 0 THEN greatest(0.0, least(3.0, vol_target / (stddev_samp(n0) OVER w{x} * sqrt(252.0::DOUBLE)))) ELSE 1.0 END" for x in looks)
    windows = "".join(f", w{x} AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN {x - 1} PRECEDING AND CURRENT ROW)" for x in looks)
    return [
        ("sc", f"SELECT * FROM (VALUES {values}) t(sid, pred_set, q, delay, horizon, bps, maxp, cap, gt, vol_target, lookback, minp)"),
        ("rkd", f"SELECT *, row_number() OVER (PARTITION BY pred_set, date ORDER BY pred DESC, event_id) AS rn, count(*) OVER (PARTITION BY pred_set, date) AS n FROM {preds}"),
        ("bs", "SELECT d.date, (SELECT min(pos) FROM cal WHERE cal.date >= d.date) AS base FROM (SELECT DISTINCT date FROM rkd) d"),
        ("tk", "SELECT sc.sid, r.ticker, r.date, r.rn, r.n, b.base + sc.delay AS entry, b.base + sc.delay + sc.horizon AS leave, least(greatest(1, CAST(floor(sc.q * r.n) AS BIGINT)), r.n // 2) AS k FROM rkd r JOIN bs b ON r.date = b.date JOIN sc ON sc.pred_set = r.pred_set WHERE r.n >= greatest(2, sc.minp)"),
        ("tr", "SELECT sid, ticker, entry, leave, date, rn, CASE WHEN rn <= k THEN 1 ELSE -1 END AS side FROM tk WHERE (rn <= k OR rn > n - k) AND leave < (SELECT count(*) FROM cal)"),
        ("sq", "SELECT *, row_number() OVER (PARTITION BY sid ORDER BY entry, leave, ticker, date, side DESC, rn) AS seq FROM tr"),
        ("ev", "SELECT sid, ticker, entry AS pos, seq, side, 1 AS opens FROM sq UNION ALL SELECT sid, ticker, leave, seq, 0, 0 FROM sq"),
        ("te", "SELECT sid, ticker, pos, side FROM (SELECT *, row_number() OVER (PARTITION BY sid, ticker, pos ORDER BY opens DESC, seq DESC) AS o FROM ev) WHERE o = 1"),
        ("gr", "SELECT t.sid, t.ticker, cal.pos, cal.date FROM (SELECT DISTINCT sid, ticker FROM te) t CROSS JOIN cal"),
        ("ac", "SELECT * FROM (SELECT gr.sid, gr.ticker, gr.pos, gr.date, last_value(te.side IGNORE NULLS) OVER (PARTITION BY gr.sid, gr.ticker ORDER BY gr.pos) AS side FROM gr LEFT JOIN te ON te.sid = gr.sid AND te.ticker = gr.ticker AND te.pos = gr.pos) WHERE side <> 0"),
        ("lc", "SELECT ac.*, sc.maxp, sc.maxp // 2 AS half, sum(CASE WHEN side > 0 THEN 1 ELSE 0 END) OVER d AS nl, sum(CASE WHEN side < 0 THEN 1 ELSE 0 END) OVER d AS ns, row_number() OVER (PARTITION BY ac.sid, ac.pos, side ORDER BY ticker) AS place FROM ac JOIN sc ON sc.sid = ac.sid WINDOW d AS (PARTITION BY ac.sid, ac.pos)"),
        ("lk", "SELECT *, least(ns, maxp - least(nl, half)) AS ks FROM lc"),
        ("lm", "SELECT sid, ticker, pos, date, side FROM lk WHERE nl + ns <= maxp OR place <= CASE WHEN side < 0 THEN ks WHEN ks < maxp - half THEN least(nl, maxp - ks) ELSE least(nl, half) END"),
        ("wr", "SELECT lm.*, side * sc.gt / count(*) OVER (PARTITION BY lm.sid, pos) AS raw, sc.cap, sc.gt FROM lm JOIN sc ON sc.sid = lm.sid"),
        ("wc", "SELECT *, greatest(-cap, least(cap, raw)) AS capped FROM wr"),
        ("wt", "SELECT *, capped * coalesce(gt / nullif(sum(abs(capped)) OVER (PARTITION BY sid, pos), 0), 0) AS w FROM wc"),
        ("dn", "SELECT gr.sid, gr.pos, gr.ticker, coalesce(wt.w, 0) AS w, coalesce(wt.w, 0) - lag(coalesce(wt.w, 0), 1, 0) OVER (PARTITION BY gr.sid, gr.ticker ORDER BY gr.pos) AS dw FROM gr LEFT JOIN wt ON wt.sid = gr.sid AND wt.ticker = gr.ticker AND wt.pos = gr.pos"),
        ("tv", "SELECT sid, pos, sum(abs(dw)) AS turnover FROM dn GROUP BY 1, 2"),
        ("hd", "SELECT wt.sid, wt.pos, count(*) AS n_active, sum(CASE WHEN side > 0 THEN 1 ELSE 0 END) AS n_long, sum(CASE WHEN side < 0 THEN 1 ELSE 0 END) AS n_short, sum(abs(w)) AS gross_exposure, sum(w * coalesce(rt.ret, 0)) AS gross FROM wt LEFT JOIN rt ON rt.ticker = wt.ticker AND rt.date = wt.date GROUP BY 1, 2"),
        ("dy", "SELECT sc.sid, cal.pos, cal.date, sc.vol_target, sc.lookback, coalesce(n_active, 0) AS n_active, coalesce(n_long, 0) AS n_long, coalesce(n_short, 0) AS n_short, coalesce(gross_exposure, 0) AS gross_exposure, coalesce(turnover, 0) AS turnover, coalesce(gross, 0) AS g0, coalesce(turnover, 0) * sc.bps * CAST(1e-4 AS DOUBLE) AS c0 FROM sc CROSS JOIN cal LEFT JOIN hd ON hd.sid = sc.sid AND hd.pos = cal.pos LEFT JOIN tv ON tv.sid = sc.sid AND tv.pos = cal.pos"),
        ("dz", "SELECT *, g0 - c0 AS n0 FROM dy"),
        ("lv", (f"SELECT *, CASE {lever} ELSE 1.0 END AS lev FROM dz WINDOW {windows[2:]}" if looks else "SELECT *, CAST(1.0 AS DOUBLE) AS lev FROM dz")),
        ("ed", "SELECT sid, date, pos, n_active, n_long, n_short, gross_exposure, turnover, c0 * lev AS cost, lev, g0 * lev AS ret_gross, n0 * lev AS ret_net FROM lv"),
        ("eq", "SELECT *, product(1 + ret_gross) OVER w AS equity_gross, product(1 + ret_net) OVER w AS equity_net FROM ed WINDOW w AS (PARTITION BY sid ORDER BY pos ROWS UNBOUNDED PRECEDING)"),
        ("dd", "SELECT *, equity_gross / max(equity_gross) OVER w - 1 AS dg, equity_net / max(equity_net) OVER w - 1 AS dn FROM eq WINDOW w AS (PARTITION BY sid ORDER BY pos ROWS UNBOUNDED PRECEDING)"),
        ("sm", f"SELECT sid AS scenario_id, count(*) AS days, {_sharpe('ret_gross')} AS sharpe_gross, {_sharpe('ret_net')} AS sharpe_net, min(dg) AS maxdd_gross, min(dn) AS maxdd_net, avg(turnover) AS mean_turnover, avg(cost) AS mean_cost, avg(n_active) AS avg_active, avg(n_long) AS avg_long, avg(n_short) AS avg_short FROM dd GROUP BY 1"),
    ]


def rounded(columns: str, digits: int = 8) -> str:
    """round() of each named column."""
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))
