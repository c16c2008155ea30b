"""Deflated sharpes, regime sets, stress arms, audits and ledger details, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import covariance as K
from panelweave.operators import cross_section as C
from panelweave.operators import events as V
from panelweave.operators import ledger as O
from panelweave.operators import metrics as M
from panelweave.operators import pnl as L
from panelweave.operators import rolling as W
from panelweave.operators import state as P
from panelweave.plans import catalog as base
from panelweave.plans.oracle import mean, r
from panelweave.plans.registry import add


def cdf(z: str, steps: int = 128) -> str:
    """The normal distribution function by the same rule as in Spark."""
    end = f"greatest(-8, least(8, {z}))"
    return f"0.5 + list_sum(list_transform(range(0, {steps + 1}), lambda i: CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({end} * i / {steps}, 2) / 2))) * {end} / (3 * {steps} * sqrt(2 * pi()))"


_LUCK = M.luck(20)
_Z = "(sr - {bar}) * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12))"
add(
    "deflated_probability",
    lambda x: M.deflated_sharpe(x.nets, 20),
    f"""WITH {base._MOM}, b AS (SELECT *, {_LUCK!r} / sqrt(n - 1) AS bar, {_LUCK!r} * coalesce(stddev_samp(sr) OVER (), 0) AS bar_trials FROM ms), c AS (SELECT *, {_Z.format(bar="bar")} AS z1, {_Z.format(bar="bar_trials")} AS z2 FROM b)
    SELECT book, n, {r("sr", "sr")}, {r("bar", "bar")}, {r(f"CASE WHEN n >= 10 THEN coalesce({cdf('z1')}, 0) ELSE 0 END", "p")}, {r("bar_trials", "bar_trials")}, {r(f"CASE WHEN n >= 10 THEN coalesce({cdf('z2')}, 0) ELSE 0 END", "p_trials")} FROM c""",
)
_PAST = "ORDER BY date ROWS UNBOUNDED PRECEDING"
_SETS = {
    "index": f"CASE WHEN volx > avg(volx) OVER ({_PAST}) THEN 'high' ELSE 'low' END",
    "trend": "CASE WHEN mkt > avg(mkt) OVER (ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) THEN 'above' ELSE 'below' END",
    "drawdown": f"CASE WHEN mkt < 0.98 * max(mkt) OVER ({_PAST}) THEN 'deep' WHEN mkt < max(mkt) OVER ({_PAST}) THEN 'shallow' ELSE 'peak' END",
    "week": "CASE WHEN mkt_ret > 0 THEN 'up' ELSE 'down' END",
    "quarter": "'q' || quarter(date)",
    "half": "CASE WHEN mkt > lag(mkt, 26) OVER (ORDER BY date) THEN 'rising' ELSE 'falling' END",
}
_LABELS = " UNION ALL ".join(f"SELECT date, '{k}' AS \"set\", lag(l) OVER (ORDER BY date) AS label, mkt_ret FROM (SELECT date, mkt_ret, {v} AS l FROM fx_macro)" for k, v in _SETS.items())
add(
    "regime_report",
    lambda x: M.regime_report(x.nets, M.regime_sets(x.macro)),
    f"""WITH {base._DD}, g AS ({_LABELS}), h AS (SELECT d.book, g."set", g.label, d.net, ln(1 + d.net) AS l, ln(1 + coalesce(mkt_ret, 0)) AS m, CAST(nav / peak - 1 < 0 AS INTEGER) AS u FROM dd1 d JOIN g USING (date) WHERE label IS NOT NULL),
    k AS (SELECT book, "set", label, count(*) AS days, sum(l) AS log_net, sum(l - m) AS relative, {base._SR("net")} AS sharpe, sum(u) AS u FROM h GROUP BY 1, 2, 3)
    SELECT book, "set", label, days, {r("log_net", "log_net")}, {r("relative", "relative")}, {r("sharpe", "sharpe")}, {r('u / nullif(sum(u) OVER (PARTITION BY book, "set"), 0)', "under_share")} FROM k""",
)
_K = "PARTITION BY book, ticker ORDER BY date"
_ARMS = {
    "as_is": f"lag(w) OVER ({_K})",
    "late": f"lag(w, 2) OVER ({_K})",
    "half_fill": f"(coalesce(lag(w) OVER ({_K}), 0) + coalesce(lag(w, 2) OVER ({_K}), 0)) / 2",
    "missed": f"lag(kept) OVER ({_K})",
}
_VARIANTS = [("as_is", "base", 10, 10), ("as_is", "half", 5, 5), ("as_is", "double", 20, 20), ("as_is", "fourfold", 40, 40), ("as_is", "dearer", 15, 15), ("as_is", "stressed", 10, 30), ("late", "late", 10, 10), ("half_fill", "half_fill", 10, 10), ("missed", "missed", 10, 10)]
add(
    "stress_variants",
    lambda x: L.stress_variants(x.weights, x.returns.select("date", "ticker", "ret"), x.calendar.select("date", "pos"), x.macro.select("date", F.col("volx").alias("v")), 10.0, 1.2),
    f"""WITH s0 AS (SELECT h.*, coalesce(last_value(CASE WHEN (pos * 48271) % 2147483647 % 10 <> 0 THEN w END IGNORE NULLS) OVER ({_K} ROWS UNBOUNDED PRECEDING), 0) AS kept FROM fx_held0 h JOIN fx_calendar USING (date)),
    s1 AS ({" UNION ALL ".join(f"SELECT book, date, ticker, '{k}' AS arm, coalesce({v}, 0) AS held FROM s0" for k, v in _ARMS.items())}), s2 AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY book, ticker, arm ORDER BY date), 0)) AS traded FROM s1),
    s3 AS (SELECT book, arm, date, coalesce(sum(held * ret), 0) AS gross, sum(traded) AS traded FROM s2 LEFT JOIN (SELECT date, ticker, ret FROM fx_returns) USING (date, ticker) GROUP BY 1, 2, 3),
    s4 AS (SELECT date, coalesce(lag(volx) OVER (ORDER BY date) > 1.2, false) AS high FROM fx_macro), v(arm, variant, lo, hi) AS (VALUES {", ".join(str(v) for v in _VARIANTS)}),
    s5 AS (SELECT book, variant, gross, traded * CASE WHEN high THEN hi ELSE lo END / 1e4 AS cost FROM s3 JOIN s4 USING (date) JOIN v USING (arm))
    SELECT book, variant, {r("sum(gross - cost)", "total")}, {r("min(gross - cost)", "worst")}, {r("sum(cost)", "cost")} FROM s5 GROUP BY 1, 2""",
)
_DAYS = {"click": 1, "purchase": 2, "error": 3}
_SHIFT = "CASE series " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _DAYS.items()) + " ELSE 0 END"
_BASE = "(obs_date - CAST(greatest(isodow(obs_date) - 5, 0) AS INTEGER))"
_AVAIL = f"CAST({_BASE} + CAST({_SHIFT} + 2 * ((isodow({_BASE}) - 1 + {_SHIFT}) // 5) AS INTEGER) AS DATE)"
_AT = "(SELECT min(obs_date) + CAST((max(obs_date) - min(obs_date)) // 2 AS INTEGER) FROM fx_series)"
_LAG = "OVER (PARTITION BY series ORDER BY obs_date)"


def _audits(x):  # noqa: ANN001, ANN202
    middle = x.series.agg((F.date_add(F.min("obs_date"), F.floor(F.datediff(F.max("obs_date"), F.min("obs_date")) / 2).cast("int"))).alias("d")).first()["d"]  # one row
    return V.leakage_audits(x.series, _DAYS, F.lit(middle), 5, 0.9)


add(
    "leakage_audits",
    _audits,
    f"""WITH k AS (SELECT series, {_AVAIL} AS avail_date, arg_max(value, obs_date) AS value, max(obs_date) AS obs_date FROM fx_series GROUP BY 1, 2),
    p AS (SELECT series, {_AVAIL} AS avail_date, arg_max(CASE WHEN obs_date >= {_AT} THEN -1e9 ELSE value END, obs_date) AS v FROM fx_series GROUP BY 1, 2),
    g AS (SELECT *, obs_date - lag(obs_date) {_LAG} AS gap, value - lag(value) {_LAG} AS c FROM fx_series),
    q AS (SELECT CASE WHEN var_pop(a.c) > 1e-18 AND var_pop(b.c) > 1e-18 THEN corr(a.c, b.c) END AS c FROM g a JOIN g b ON a.obs_date = b.obs_date AND a.series < b.series WHERE a.c IS NOT NULL AND b.c IS NOT NULL GROUP BY a.series, b.series),
    o AS (SELECT 'availability' AS audit, count(*) AS cells, count(*) FILTER (avail_date - obs_date < {_SHIFT}) AS leaks FROM k UNION ALL SELECT 'calendar', count(*), count(*) FILTER (isodow(avail_date) > 5) FROM k
        UNION ALL SELECT 'poison', count(*), count(*) FILTER (k.value IS DISTINCT FROM p.v) FROM k LEFT JOIN p USING (series, avail_date) WHERE avail_date < {_AT}
        UNION ALL SELECT 'staleness', count(*), count(*) FILTER (gap > 5) FROM g UNION ALL SELECT 'cross_source', count(*), count(*) FILTER (abs(c) > 0.9) FROM q)
    SELECT audit, cells, leaks, CASE WHEN leaks = 0 THEN 'PASS' ELSE 'BLOCK' END AS verdict FROM o""",
)
_RATE = "sum(filled_qty) FILTER ({c}) / nullif(sum(qty) FILTER ({c}), 0)"
_SG = "CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END"
add(
    "reconcile_detail",
    lambda x: O.reconcile_detail(x.fills, x.sectors.select("ticker", F.col("sector").isin("AMERICA", "EUROPE").alias("core"))),
    f"""WITH x AS (SELECT f.*, sector IN ('AMERICA', 'EUROPE') AS core FROM fx_fills f JOIN fx_sectors USING (ticker)),
    g AS (SELECT session, sum(qty - filled_qty) FILTER (status <> 'rejected') / nullif(sum(qty), 0) AS cancelled, {_RATE.format(c="core")} AS core_rate, {_RATE.format(c="NOT core")} AS other_rate, sum(abs(qty - filled_qty)) AS open_qty,
        sum({_SG} * (price - close) * filled_qty) / nullif(sum(filled_qty * close), 0) AS drag, sum({_SG} * filled_qty) AS net_qty FROM x GROUP BY session),
    h AS (SELECT *, CAST(abs(net_qty) < 30 AS INTEGER) AS flat FROM g), i AS (SELECT *, sum(1 - flat) OVER (ORDER BY session) AS seg FROM h), j AS (SELECT *, CAST(sum(flat) OVER (PARTITION BY seg ORDER BY session) AS BIGINT) AS flat_streak FROM i)
    SELECT session, {r("cancelled", "cancelled")}, {r("core_rate", "core_rate")}, {r("other_rate", "other_rate")}, {r("open_qty", "open_qty")}, {r("drag", "drag")}, {r("net_qty", "net_qty")}, flat_streak,
        concat_ws('|', CASE WHEN cancelled > 0.3 THEN 'cancels' END, CASE WHEN round(abs(core_rate - other_rate), 9) > 0.5 THEN 'classes' END, CASE WHEN flat_streak >= 3 THEN 'silent' END) AS alarms FROM j""",
)
add("expanding_ridge", lambda x: K.expanding_ols(base._feat(x), 24, 12, 0.25), f"WITH {base._LSIG}, {base._OLS.replace('nullif(xx * n - x * x, 0)', 'nullif((xx * n - x * x) * 1.25, 0)')} SELECT signalname, lf.date, {r('a + b * mom', 'prediction')} FROM lf JOIN ok USING (date) WHERE mom IS NOT NULL")
add(
    "expand_runs",
    lambda x: P.trades(base._bands(x)).select("ticker", F.col("start").alias("opened"), "side", F.explode(F.sequence("start", "end", F.expr("interval 7 days"))).alias("date")).join(x.calendar.select("date"), "date", "left_semi"),
    f"WITH {base._TRADES} SELECT t3.ticker, t3.start AS opened, side, d.date FROM t3 JOIN fx_days d ON d.date BETWEEN t3.start AND t3.\"end\"",
)

add(
    "panel_gaps",
    lambda x: V.panel_gaps(x.panel, few=0.98),
    """WITH d AS (SELECT date, count(close) AS n FROM fx_panel GROUP BY date), u AS (SELECT median(n) AS usual, max(date) AS last FROM d), g AS (SELECT *, date - lag(date) OVER (ORDER BY date) AS gap FROM d)
    SELECT 'gap' AS kind, CAST(NULL AS VARCHAR) AS ticker, date FROM g WHERE gap > 7 UNION ALL SELECT 'phantom', NULL, date FROM d CROSS JOIN u WHERE n < 0.98 * usual
    UNION ALL SELECT 'early_end', ticker, l FROM (SELECT ticker, max(date) AS l FROM fx_panel WHERE close IS NOT NULL GROUP BY ticker) CROSS JOIN u WHERE l < last""",
)
_CUT = "1999-01-01"


def _poisoned(x):  # noqa: ANN001, ANN202
    """Quantile weights of the panel and of one whose closes from the cut on are nonsense."""
    weigh = lambda p: C.quantile_weights(W.momentum(p, 13, 1), 5, "mom")
    bad = x.returns.withColumn("close", F.when(F.col("date") >= F.lit(_CUT).cast("date"), F.lit(1.0) + F.pmod(F.hash("ticker", "date"), F.lit(97))).otherwise(F.col("close")))
    return V.truncation_audit(weigh(x.returns), weigh(bad).where(F.col("date") < F.lit(_CUT).cast("date")), ["date", "ticker"], "w")


add("weight_poison", _poisoned, f"WITH {base._BUCKET} SELECT count(*) AS cells, CAST(0 AS BIGINT) AS leaks, 'PASS' AS verdict FROM q1 WHERE n >= 5 AND bucket IN (0, 4) AND date < DATE '{_CUT}'")
_BUCKETS = {"short": ("click", "view", "signup", 1.75), "middle": ("purchase", "view", "click", 5.0), "long": ("error", "view", "purchase", 20.0)}
_KINDS = ("click", "view", "signup", "purchase", "error")
add(
    "sig_bond_carry",
    lambda x: V.bond_carry(x.series.groupBy(F.col("obs_date").alias("date")).agg(*[F.max(F.when(F.col("series") == k, F.col("value"))).alias(k) for k in _KINDS]), _BUCKETS),
    f"""WITH w AS (SELECT obs_date AS date, {", ".join(f"max(value) FILTER (series = '{k}') AS {k}" for k in _KINDS)} FROM fx_series GROUP BY 1),
    b AS ({" UNION ALL ".join(f"SELECT date, '{k}' AS bucket, ({y} - {f}) + ({y} - {s}) / {n} AS carry FROM w" for k, (y, f, s, n) in _BUCKETS.items())})
    SELECT date, bucket, {r("carry", "carry")}, {r("(carry - avg(carry) OVER (PARTITION BY date)) / nullif(stddev_pop(carry) OVER (PARTITION BY date), 0)", "z")} FROM b WHERE carry IS NOT NULL""",
)

# parameter maps and per-asset studies: a cell of the grid is a key
_GRID = [(s, n, m) for s in (0.005, 0.01) for n in (8, 13) for m in (26, 40)]


def _study(x):  # noqa: ANN001, ANN202
    return M.asset_study(x.returns.select("ticker", "date", "ret", "close").where("close is not null"), _GRID)
