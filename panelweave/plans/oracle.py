"""The fixtures' rules in SQL, and the wrapping of a query with those that it names."""

from __future__ import annotations

import re


def r(x: str, name: str) -> str:
    """A double rounded for comparison between engines; no negative zero."""
    return f"(round({x}, 6) + 0.0) AS {name}"


def roll(agg: str, x: str, n: int, key: str = "ticker", order: str = "date") -> str:
    """A trailing window aggregate that is null unless n values are present."""
    w = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg} {w} END"


def mean(x: str, n: int, key: str = "ticker") -> str:
    return roll(f"avg({x})", x, n, key)


def std(x: str, n: int, key: str = "ticker") -> str:
    return roll(f"stddev_samp({x})", x, n, key)


def total(x: str, n: int, key: str = "ticker") -> str:
    return roll(f"sum({x})", x, n, key)


def lag(x: str, n: int = 1, key: str = "ticker") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {key} ORDER BY date)"


def sharpe(x: str, per_year: int = 52) -> str:
    return f"CASE WHEN count({x}) < 2 OR coalesce(stddev_samp({x}), 0) <= 1e-18 THEN 0.0 ELSE avg({x}) / stddev_samp({x}) * sqrt({per_year}.0) END"


def scramble(a: str, b: str) -> str:
    h = f"((({a}) * 1009 + ({b}) * 9176 + 12345) * 48271 % 2147483647)"
    return f"(({h} * {h} + 31 * {h}) % 2147483647 * 69621 % 2147483647)"


def bartlett(x: str, lags: int) -> tuple[str, str]:
    """Products of x with its lags over window w, and their Newey-West sum."""
    products = ", ".join([f"{x} * {x} AS c_{x}0", *[f"{x} * lag({x}, {k}) OVER w AS c_{x}{k}" for k in range(1, lags + 1)]])
    return products, f"(sum(c_{x}0)" + "".join(f" + {2 * (1 - k / (lags + 1))!r} * coalesce(sum(c_{x}{k}), 0)" for k in range(1, lags + 1)) + ")"


def nw_line(src: str, keys: str, lags: int, term: str) -> str:
    """CTEs up to `nw`: (keys, n, r2, term, coef, t) of y on a constant and x in src(keys, date, y, x)."""
    (pa, va), (pb, vb) = bartlett("ga", lags), bartlett("gb", lags)
    ok = "y IS NOT NULL AND x IS NOT NULL"
    return f"""o1 AS (SELECT {keys}, count(*) AS n, avg(y) AS my, avg(x) AS mx, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) / nullif(var_pop(x), 0) AS b FROM {src} WHERE {ok} GROUP BY {keys}),
        o2 AS (SELECT {keys}, date, n, vy, my - b * mx AS a, b, y - (my - b * mx) - b * x AS u, x - mx AS d, mx, vx FROM {src} JOIN o1 USING ({keys}) WHERE {ok}),
        o3 AS (SELECT *, u * (1.0 / n - mx * d / (n * vx)) AS ga, u * d / (n * vx) AS gb FROM o2), o4 AS (SELECT *, {pa}, {pb} FROM o3 WINDOW w AS (PARTITION BY {keys} ORDER BY date)),
        o5 AS (SELECT {keys}, first(n) AS n, 1 - sum(u * u) / nullif(first(vy) * first(n), 0) AS r2, first(a) AS a, first(b) AS b, sqrt(greatest({va}, 0)) AS sa, sqrt(greatest({vb}, 0)) AS sb FROM o4 GROUP BY {keys}),
        nw AS (SELECT {keys}, n, r2, 'const' AS term, a AS coef, a / nullif(sa, 0) AS t FROM o5 UNION ALL SELECT {keys}, n, r2, '{term}', b, b / nullif(sb, 0) FROM o5)"""


_TICKER = "'N' || lpad(CAST({} AS VARCHAR), 2, '0')"

VIEWS = {
    "fx_prints": f"""SELECT {_TICKER.format("s_nationkey")} AS ticker, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus, l_tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "fx_cells": """SELECT ticker, CAST(date_trunc('week', ts) AS DATE) AS date, CAST(sum(cents) AS DOUBLE) / 100 / CAST(sum(CAST(qty AS BIGINT)) AS DOUBLE) AS v, CAST(sum(CAST(qty AS BIGINT)) AS DOUBLE) AS volume, count(*) AS n,
        first(price ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p0 FROM fx_prints GROUP BY 1, 2""",
    "fx_steps": """SELECT *, greatest(-1, least(1, v / (SELECT avg(v) FROM fx_cells) - 1)) / 25 AS step, greatest(-1, least(1, p0 / v - 1)) AS gap FROM fx_cells""",
    "fx_levels": "SELECT *, 100 * exp(sum(step) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close FROM fx_steps",
    "fx_bars": "SELECT date, ticker, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY date), 100) * (1 + gap / 100) AS open, close, volume, n FROM fx_levels",
    "fx_days": "SELECT DISTINCT date FROM fx_bars",
    "fx_calendar": """SELECT date, row_number() OVER (ORDER BY date) AS pos, CAST(date_trunc('month', date) AS DATE) AS month, coalesce(lag(date_trunc('month', date)) OVER (ORDER BY date) <> date_trunc('month', date), true) AS month_first,
        coalesce(lead(date_trunc('month', date)) OVER (ORDER BY date) <> date_trunc('month', date), true) AS month_last, coalesce(lead(date_trunc('month', date)) OVER (ORDER BY date) <> date_trunc('month', date), false) AS month_end_confirmed FROM fx_days""",
    "fx_sectors": f"SELECT {_TICKER.format('n_nationkey')} AS ticker, r_name AS sector, n_name AS company FROM nation JOIN region ON n_regionkey = r_regionkey",
    "fx_totals": f"""SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, {_TICKER.format("c_nationkey")} AS ticker, c_nationkey AS k, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "fx_floor": "SELECT date, quantile_cont(total, 0.3) AS floor FROM fx_totals GROUP BY date",
    "fx_changes": "SELECT date, list(ticker ORDER BY ticker) AS members FROM fx_totals JOIN fx_floor USING (date) WHERE total >= floor GROUP BY date",
    "fx_spans": "SELECT date AS start, lead(date) OVER (ORDER BY date) AS stop, members FROM fx_changes",
    "fx_panel": """SELECT d.date, t.ticker, b.open, b.close, b.volume, b.n, coalesce(list_contains(s.members, t.ticker), false) AS member FROM fx_days d CROSS JOIN (SELECT DISTINCT ticker FROM fx_bars) t
        LEFT JOIN fx_bars b ON b.date = d.date AND b.ticker = t.ticker LEFT JOIN fx_spans s ON d.date >= s.start AND (s.stop IS NULL OR d.date < s.stop)""",
    "fx_returns": "SELECT p.*, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret, sector FROM fx_panel p JOIN fx_sectors USING (ticker)",
    "fx_factor": "SELECT *, avg(ret) OVER (PARTITION BY date, sector) AS f, avg(ret) OVER (PARTITION BY date) AS m FROM fx_returns",
    "fx_market": "SELECT date, avg(ret) AS ret FROM fx_returns GROUP BY date",
    "fx_levels5": "SELECT date, dense_rank() OVER (ORDER BY sector) - 1 AS k, ret, 100 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close FROM (SELECT date, sector, avg(ret) AS ret FROM fx_returns GROUP BY 1, 2)",
    "fx_wide5": "SELECT date, " + ", ".join(f"max(close) FILTER (k = {i}) AS r{i}, max(ret) FILTER (k = {i}) AS r{i}_ret" for i in range(5)) + " FROM fx_levels5 GROUP BY date",
    "fx_macro": """SELECT c.date, pos, month_first, month_end_confirmed, m.ret AS mkt_ret, 100 * exp(sum(ln(1 + coalesce(m.ret, 0))) OVER d) AS mkt, CASE WHEN count(m.ret) OVER w = 8 THEN 100 * sqrt(52.0) * stddev_samp(m.ret) OVER w END AS volx,
        pow(1.0005, pos) AS cash, CASE WHEN pos > 1 THEN 1.0005 - 1 END AS cash_ret, v.* EXCLUDE (date) FROM fx_calendar c JOIN fx_market m USING (date) JOIN fx_wide5 v USING (date)
        WINDOW d AS (ORDER BY c.date ROWS UNBOUNDED PRECEDING), w AS (ORDER BY c.date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "fx_mom": "SELECT *, lag(close, 1) OVER (PARTITION BY ticker ORDER BY date) / lag(close, 13) OVER (PARTITION BY ticker ORDER BY date) - 1 AS mom FROM fx_returns",
    "fx_ranked": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS u, row_number() OVER (PARTITION BY date ORDER BY mom, ticker) AS d FROM fx_mom WHERE mom IS NOT NULL",
    "fx_region": "SELECT date, sector FROM (SELECT date, sector, row_number() OVER (PARTITION BY date ORDER BY avg(mom) DESC, sector) AS k FROM fx_ranked GROUP BY date, sector) WHERE k = 1",
    "fx_weights": """SELECT 'bk_ew' AS book, date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS w FROM fx_panel WHERE close IS NOT NULL
        UNION ALL SELECT 'bk_mom', date, ticker, CASE WHEN u <= 5 THEN 0.2::DOUBLE ELSE -0.2::DOUBLE END FROM fx_ranked WHERE u <= 5 OR d <= 5
        UNION ALL SELECT 'bk_rot', date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) FROM fx_ranked JOIN fx_region USING (date, sector)""",
    "fx_held0": """SELECT g.book, d.date, g.ticker, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT book, ticker FROM fx_weights) g CROSS JOIN fx_days d LEFT JOIN fx_weights w ON w.book = g.book AND w.ticker = g.ticker AND w.date = d.date""",
    "fx_held": "SELECT *, coalesce(lag(w, 1) OVER k, 0) AS held, abs(coalesce(lag(w, 1) OVER k, 0) - coalesce(lag(w, 2) OVER k, 0)) AS traded FROM fx_held0 WINDOW k AS (PARTITION BY book, ticker ORDER BY date)",
    "fx_nets": """SELECT book, date, coalesce(sum(held * ret), 0) AS gross, sum(traded) * 0.001 AS cost, coalesce(sum(held * ret), 0) - sum(traded) * 0.001 AS net, sum(traded) AS turnover
        FROM fx_held LEFT JOIN (SELECT date, ticker, ret FROM fx_returns) USING (date, ticker) GROUP BY book, date""",
    "fx_earnings": """SELECT ticker AS symbol, date AS period, CAST(CAST(date + INTERVAL 3 MONTH AS DATE) + CAST(19 + k % 10 AS INTEGER) AS DATE) AS report_date, CASE WHEN k % 2 = 0 THEN 'bmo' ELSE 'amc' END AS hour,
        lag(total / 1e8) OVER (PARTITION BY ticker ORDER BY date) AS estimate, total / 1e8 AS actual, date >= DATE '1998-01-01' AS point_in_time FROM fx_totals""",
    "fx_sessions": """SELECT e.*, (SELECT min(c.date) FROM fx_days c WHERE c.date >= CASE WHEN hour = 'bmo' THEN report_date ELSE report_date + 1 END) AS session FROM fx_earnings e""",
    "fx_series": "SELECT event_type AS series, CAST(ts AS DATE) AS obs_date, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / 10000 / count(value) AS value FROM events GROUP BY 1, 2",
    "fx_port": """SELECT p_brand AS signalname, CASE l_returnflag WHEN 'A' THEN '01' WHEN 'N' THEN '02' ELSE '03' END AS port, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) - 5 AS ret
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "fx_signals": "SELECT * FROM fx_port UNION ALL SELECT h.signalname, 'LS', h.date, h.ret - l.ret FROM fx_port h JOIN fx_port l ON h.signalname = l.signalname AND h.date = l.date WHERE h.port = '03' AND l.port = '01'",
    "fx_fills": """SELECT p.ticker, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'partially_filled' ELSE 'rejected' END AS status, qty,
        CASE o_orderstatus WHEN 'F' THEN qty WHEN 'O' THEN floor(qty / 2) ELSE 0 END AS filled_qty, b.close * (1 + (l_tax - 0.04) / 20) AS price, b.close, CAST(ts AS DATE) AS session, b.date AS week,
        l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS client_order_id, CAST(ts AS TIMESTAMP) - INTERVAL 1 DAY + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS submitted_at
        FROM fx_prints p JOIN orders ON l_orderkey = o_orderkey JOIN fx_bars b ON b.ticker = p.ticker AND b.date = CAST(date_trunc('week', ts) AS DATE)""",
}


def wrap(body: str) -> str:
    """body with a WITH clause of the fixtures it names, directly or through others."""
    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in need:
                visit(VIEWS[name])
                need[name] = None

    visit(body)
    own = ""
    if body.lstrip().upper().startswith("WITH "):
        own, body = ", " + body.lstrip()[5:], ""
        return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) + own if need else "WITH " + own[2:]
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) + " " if need else "") + body
