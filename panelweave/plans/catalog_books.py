"""Registered queries of overlays, blends, perturbed inputs and summaries of books, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators import exposure as E
from panelweave.operators import pnl as L
from panelweave.operators import rolling as W
from panelweave.operators import state as P
from panelweave.plans import catalog as base
from panelweave.plans.fixtures import Fixtures
from panelweave.plans.oracle import lag, mean, nw_line, r, scramble, sharpe, std
from panelweave.plans.registry import add, add_fold

DT = ("date", "ticker")


def _ret(x: Fixtures) -> DataFrame:
    return x.returns.select("date", "ticker", "ret")


def _dates(x: Fixtures) -> DataFrame:
    return x.returns.select("date").distinct()


def _held(x: Fixtures) -> DataFrame:
    return L.held(x.weights, _dates(x))


_LEVEL = "mk AS (SELECT date, 100 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS b FROM fx_market)"
add(
    "breadth_ratio", lambda x: E.breadth_ratio(x.panel, x.market, 13),
    f"WITH {_LEVEL}, q AS (SELECT date, ticker, close / b AS close FROM fx_panel JOIN mk USING (date)) SELECT date, ticker, {r('close / ' + lag('close', 13) + ' - 1', 'breadth')} FROM q",
)


def _joint(x: Fixtures) -> DataFrame:
    return P.hysteresis(W.sma_ratio(base._target(x).join(x.panel.select(*DT, "close"), [*DT]), 8), F.col("above") > 0.01, F.col("above") < -0.01)


_JT = f"h0 AS (SELECT p.date, p.ticker, mom AS target, close / ({mean('close', 8)}) - 1 AS above FROM (SELECT date, ticker, mom, close FROM fx_mom) p), jt AS (SELECT date, ticker, target, last_value(CASE WHEN above > 0.01 THEN 1 WHEN above < -0.01 THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS gate FROM h0)"
_JS = "CASE WHEN o.gate = 0 THEN CAST(-1 AS DOUBLE) WHEN o.gate = 1 AND o.target IS NOT NULL AND ({z} < 0 OR abs(o.target - {z}) > 0.02) THEN o.target ELSE {z} END"
add_fold(
    "tolerance_band_joint", lambda x: E.tolerance_band_joint(_joint(x), 0.02),
    base._recursive(_JT, "jt", _JS.format(z="CAST(-1 AS DOUBLE)"), _JS.format(z="z.st"), f" SELECT ticker, date, {r('greatest(st, 0)', 'held')}, {r('CASE WHEN st < 0 THEN 0 ELSE 1 - st END', 'rest')} FROM z"),
)
add("l1_row_band", lambda x: E.row_band(x.weights, _dates(x), 0.5))
add(
    "overlay_cost", lambda x: E.overlay_cost(_held(x).select("book", *DT, "w"), W.rolling_beta(x.factor, 13), 5.0),
    f"WITH {base._BETA}, lb AS (SELECT date, ticker, {lag('beta')} AS b FROM b3), a AS (SELECT book, date, ticker, w * coalesce(b, 0) AS o FROM fx_held0 LEFT JOIN lb USING (date, ticker)), c AS (SELECT *, abs(o - coalesce({lag('o', key='book, ticker')}, 0)) AS d FROM a) SELECT book, date, {r('sum(o)', 'overlay')}, {r('sum(d) * 0.001', 'cost')} FROM c GROUP BY book, date",
)


def _pair_positions(x: Fixtures) -> DataFrame:
    z = W.spread_z(base._spread(x), 13).withColumn("pair", F.concat_ws("/", "a", "b"))
    return P.band_positions(z, 1.5, 0.5, value="z", key="pair")


_PP = f"""{base._SPREAD}, z0 AS (SELECT *, a || '/' || b AS pair, (spread - ({mean('spread', 13, 'a, b')})) / nullif({std('spread', 13, 'a, b')}, 0) AS z FROM sp), z1 AS (SELECT *, coalesce(abs(z) <= 0.5, false) AS flat FROM z0),
    z2 AS (SELECT *, sum(CAST(flat AS INTEGER)) OVER (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg, CASE WHEN flat THEN NULL WHEN z >= 1.5 THEN -1 WHEN z <= -1.5 THEN 1 END AS e FROM z1),
    z3 AS (SELECT *, CASE WHEN flat THEN 0 ELSE coalesce(first_value(e IGNORE NULLS) OVER (PARTITION BY pair, seg ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS position FROM z2),
    z4 AS (SELECT z3.pair, z3.date, position, x.ret - y.ret AS gap, coalesce(lag(position) OVER (PARTITION BY pair ORDER BY z3.date), 0) AS h FROM z3 LEFT JOIN fx_returns x ON x.date = z3.date AND x.ticker = a LEFT JOIN fx_returns y ON y.date = z3.date AND y.ticker = b)"""
_PNL = "coalesce(h * gap, 0) - abs(h - coalesce(lag(h) OVER (PARTITION BY pair ORDER BY date), 0)) * 0.002"
add("pair_pnl", lambda x: E.pair_pnl(_pair_positions(x), x.returns, 10.0), f"WITH {_PP} SELECT pair, date, {r(_PNL, 'net')} FROM z4")
add(
    "run_pairs", lambda x: E.pair_pnl(_pair_positions(x), x.returns, 10.0).groupBy("date").agg(F.count("*").alias("pairs"), F.avg("net").alias("net")),
    f"WITH {_PP}, z5 AS (SELECT pair, date, {_PNL} AS net FROM z4) SELECT date, count(*) AS pairs, {r('avg(net)', 'net')} FROM z5 GROUP BY date",
)


def _classes(x: Fixtures) -> DataFrame:
    return x.sectors.select("ticker", F.when(F.col("sector") == "ASIA", 2.0).otherwise(10.0).alias("bps"))


_HN = """hg AS (SELECT book, date, ticker, w * least(1, 0.9 / nullif(sum(abs(w)) OVER (PARTITION BY book, date), 0)) AS w FROM fx_weights), h0 AS (SELECT b.book, d.date, b.ticker, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT book, ticker FROM hg) b CROSS JOIN fx_days d LEFT JOIN hg w ON w.book = b.book AND w.ticker = b.ticker AND w.date = d.date),
    h1 AS (SELECT *, coalesce(lag(w, 1) OVER k, 0) AS held, abs(coalesce(lag(w, 1) OVER k, 0) - coalesce(lag(w, 2) OVER k, 0)) AS traded FROM h0 WINDOW k AS (PARTITION BY book, ticker ORDER BY date)),
    h2 AS (SELECT book, date, sum(held * ret) AS g, sum(traded * CASE WHEN sector = 'ASIA' THEN 2 ELSE 10 END / 1e4) AS cost, count(*) FILTER (held <> 0 AND ret IS NOT NULL) AS names FROM h1 JOIN fx_sectors USING (ticker) LEFT JOIN (SELECT date, ticker, ret FROM fx_returns) USING (date, ticker) GROUP BY book, date),
    hn AS (SELECT book, date, CASE WHEN names >= 2 THEN g END AS gross, cost, names FROM h2)"""
_harness = lambda x: E.harness(x.weights, _ret(x), _dates(x), _classes(x), 0.9, 2)
add("harness_run", _harness, f"WITH {_HN} SELECT book, date, {r('gross', 'gross')}, {r('cost', 'cost')}, {r('gross - cost', 'net')}, names FROM hn")
add(
    "harness_monthly", lambda x: _harness(x).groupBy("book", F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.count("net").alias("n"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("ret"), F.sum("cost").alias("cost")),
    f"WITH {_HN} SELECT book, CAST(date_trunc('month', date) AS DATE) AS month, count(gross) AS n, {r('exp(sum(ln(1 + gross - cost))) - 1', 'ret')}, {r('sum(cost)', 'cost')} FROM hn GROUP BY 1, 2",
)
_GROSS = "eg AS (SELECT book, avg(g) AS level FROM (SELECT book, date, sum(abs(held)) AS g FROM fx_held GROUP BY 1, 2) GROUP BY book)"
add(
    "summary_block", lambda x: E.summary_block(x.nets, _held(x), 52),
    f"WITH {_GROSS}, y AS (SELECT *, CASE WHEN count(net) OVER k = 52 THEN exp(sum(ln(1 + net)) OVER k) - 1 END AS y FROM fx_nets WINDOW k AS (PARTITION BY book ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)) SELECT book, {r('exp(sum(ln(1 + net)) * 52 / count(net)) - 1', 'cagr')}, {r('stddev_samp(net) * sqrt(52.0)', 'vol')}, {r('min(y)', 'worst')}, {r('max(y)', 'best')}, {r('avg(turnover) * 52', 'turnover')}, {r('avg(cost) * 52', 'cost_drag')}, {r('first(level)', 'avg_gross')} FROM y JOIN eg USING (book) GROUP BY book",
)
add("benchmark_book", lambda x: E.exposure_matched(x.nets, _held(x), x.market), f"WITH {_GROSS} SELECT book, date, {r('level * coalesce(ret, 0)', 'bench')}, {r('net - level * coalesce(ret, 0)', 'excess')} FROM fx_nets JOIN eg USING (book) JOIN fx_market USING (date)")
add(
    "mark_by_bucket", lambda x: E.mark_by_bucket(x.weights, _ret(x), _dates(x), -0.01),
    f"SELECT book, date, CASE WHEN held > 0 THEN 'long' ELSE 'short' END AS bucket, count(*) AS names, {r('coalesce(sum(held * ret), 0)', 'pnl')}, {r('coalesce(sum(held * CASE WHEN ret IS NOT NULL THEN greatest(ret, -0.01) END), 0)', 'floored')} FROM fx_held LEFT JOIN (SELECT date, ticker, ret FROM fx_returns) USING (date, ticker) WHERE held <> 0 GROUP BY 1, 2, 3",
)
_PERT = f"""p0 AS (SELECT date, ticker, close, member, row_number() OVER (PARTITION BY ticker ORDER BY date) AS p, coalesce(lag(member) OVER (PARTITION BY ticker ORDER BY date), false) AS m FROM fx_panel), p1 AS (SELECT variant, date, ticker, CASE WHEN variant = 'masked' AND {scramble('p', '3')} % 12 = 0 THEN NULL ELSE close END AS close,
    CASE variant WHEN 'late' THEN m WHEN 'strict' THEN m AND member ELSE member END AS member FROM p0 CROSS JOIN (SELECT unnest(['base', 'masked', 'late', 'strict']) AS variant)), p2 AS (SELECT *, close / lag(close) OVER (PARTITION BY variant, ticker ORDER BY date) - 1 AS ret FROM p1)"""
add(
    "panel_perturbations", lambda x: E.perturbed(x.panel.select(*DT, "close", "member"), 12).where("member and ret is not null").groupBy("variant", "date").agg(F.count("*").alias("n"), F.avg("ret").alias("ret")),
    f"WITH {_PERT} SELECT variant, date, count(*) AS n, {r('avg(ret)', 'ret')} FROM p2 WHERE member AND ret IS NOT NULL GROUP BY 1, 2",
)
add(
    "random_lag", lambda x: E.random_lag(_held(x).select("book", *DT, "w").join(x.calendar.select("date", F.col("pos").cast("long").alias("pos")), "date"), 5).where("w <> 0"),
    f"SELECT * FROM (SELECT book, ticker, date, {r('CASE WHEN ' + scramble('pos', '11') + ' % 5 = 0 THEN coalesce(lag(w) OVER (PARTITION BY book, ticker ORDER BY date), 0) ELSE w END', 'w')} FROM fx_held0 JOIN fx_calendar USING (date)) WHERE w <> 0",
)
add(
    "bracket_report", lambda x: E.bracket_report(x.nets, -0.004, 52),
    f"WITH a AS (SELECT book, net, greatest(net, -0.004) AS f, greatest(net, -0.004) - net AS p FROM fx_nets) SELECT book, count(*) AS n, {r(sharpe('net'), 'full')}, {r(sharpe('f'), 'floored')}, {r(sharpe('p'), 'premium')}, {r('sum(p)', 'drag')} FROM a GROUP BY book",
)
_EN = f"""e0 AS (SELECT f.*, month_first, 1 / nullif({std('net', 13, 'book')}, 0) AS i FROM fx_nets f JOIN fx_calendar USING (date)), e1 AS (SELECT *, i / nullif(sum(i) OVER (PARTITION BY date), 0) AS w FROM e0),
    e2 AS (SELECT *, last_value(CASE WHEN month_first THEN coalesce(w, 0) END IGNORE NULLS) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM e1), e3 AS (SELECT date, sum(coalesce(k, 0) * net) AS net FROM e2 GROUP BY date),
    e4 AS (SELECT *, CASE WHEN count(net) OVER q = 13 THEN stddev_samp(net) OVER q END * sqrt(52.0) AS v FROM e3 WINDOW q AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)), e5 AS (SELECT date, net, coalesce(least(greatest(0.01 / nullif(lag(v) OVER (ORDER BY date), 0), 0), 3), 1) AS lev, lag(v) OVER (ORDER BY date) AS b FROM e4)"""
add("ensemble_blend", lambda x: E.ensemble(x.nets, x.calendar, 13, 0.01, 52, 3.0), f"WITH {_EN} SELECT date, {r('net', 'blend')}, {r('CASE WHEN nullif(b, 0) IS NULL THEN 1 ELSE lev END', 'lev')}, {r('CASE WHEN nullif(b, 0) IS NULL THEN 1 ELSE lev END * net', 'net')} FROM e5")
_TF = f"""t0 AS (SELECT sector, date, avg(ret) AS ret FROM fx_returns GROUP BY 1, 2), t1 AS (SELECT *, CASE WHEN count(ret) OVER k = 23 THEN sign(round(sum(ret) OVER k, 12)) END AS s, {std('ret', 13, 'sector')} AS d FROM t0 WINDOW k AS (PARTITION BY sector ORDER BY date ROWS BETWEEN 26 PRECEDING AND 4 PRECEDING)), t2 AS (SELECT *, lag(d) OVER (PARTITION BY sector ORDER BY date) AS v FROM t1)"""
add("build_factors", lambda x: E.trend_factor(x.returns, 26, 4, 13), f"WITH {_TF} SELECT date, {r('avg(s * ret / CASE WHEN v > 1e-12 THEN v END)', 'trend')} FROM t2 GROUP BY date")
_MB = "mb AS (SELECT *, max(date) OVER (PARTITION BY date_trunc('month', date)) AS l FROM b3 WHERE beta IS NOT NULL)"
add("monthly_abs_beta", lambda x: E.monthly_abs_beta(W.rolling_beta(x.factor, 13)), f"WITH {base._BETA}, {_MB} SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS names, {r('avg(abs(beta))', 'abs_beta')} FROM mb WHERE date = l GROUP BY 1")
add("book_gross", lambda x: x.nets.groupBy("book", F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.sum("gross").alias("gross"), F.count("*").alias("n")), f"SELECT book, CAST(date_trunc('month', date) AS DATE) AS month, {r('sum(gross)', 'gross')}, count(*) AS n FROM fx_nets GROUP BY 1, 2")
_INC = """i0 AS (SELECT a.book, date, a.net AS x, c.net AS c FROM fx_nets a JOIN (SELECT date, net FROM fx_nets WHERE book = 'bk_ew') c USING (date) WHERE a.book <> 'bk_ew'), i1 AS (SELECT *, stddev_samp(c) OVER q / nullif(stddev_samp(c) OVER q + stddev_samp(x) OVER q, 0) AS h FROM i0 WINDOW q AS (PARTITION BY book)),
    i2 AS (SELECT book, how, date, c, CASE how WHEN 'equal' THEN 0.5 ELSE h END * x + (1 - CASE how WHEN 'equal' THEN 0.5 ELSE h END) * c AS net FROM i1 CROSS JOIN (SELECT unnest(['equal', 'inverse_vol']) AS how)), i3 AS (SELECT *, sum(net) OVER (PARTITION BY book, how ORDER BY date ROWS UNBOUNDED PRECEDING) AS n FROM i2),
    i4 AS (SELECT *, max(n) OVER (PARTITION BY book, how ORDER BY date ROWS UNBOUNDED PRECEDING) AS t FROM i3)"""
add("incremental_value", lambda x: E.incremental_value(x.nets, "bk_ew", 52), f"WITH {_INC} SELECT book, how, {r(sharpe('net'), 'sharpe')}, {r('stddev_samp(net) * sqrt(52.0)', 'vol')}, {r('min(n - greatest(t, 0))', 'dd')}, {r('(avg(net) - avg(c) * stddev_samp(net) / nullif(stddev_samp(c), 0)) * 52', 'gain')} FROM i4 GROUP BY 1, 2")
_LIMITS = {"corr": 0.5, "corr_down": 0.6, "corr_worst": 0.6, "r2": 0.4}
_BINDING = "CASE " + " ".join(f"WHEN abs({k}) > {v} THEN '{k}'" for k, v in _LIMITS.items()) + " END"
add(
    "orthogonality_score", lambda x: E.orthogonality(x.nets, "bk_ew", _LIMITS, 6),
    f"""WITH ct AS (SELECT date, net AS c FROM fx_nets WHERE book = 'bk_ew'), ob AS (SELECT book, date, net AS y, c AS x, percent_rank() OVER (PARTITION BY book ORDER BY c, date) AS q FROM fx_nets JOIN ct USING (date) WHERE book <> 'bk_ew'), {nw_line("ob", "book", 6, "c")},
    og AS (SELECT book, count(*) AS n, corr(y, x) AS corr, corr(y, x) FILTER (x < 0) AS corr_down, corr(y, x) FILTER (q < 0.1) AS corr_worst FROM ob GROUP BY book), oh AS (SELECT og.*, nw.r2, nw.t AS alpha_t FROM og JOIN nw ON nw.book = og.book AND term = 'const'), oi AS (SELECT *, {_BINDING} AS binding FROM oh)
    SELECT book, n, {r("corr", "corr")}, {r("corr_down", "corr_down")}, {r("corr_worst", "corr_worst")}, {r("r2", "r2")}, {r("alpha_t", "alpha_t")}, binding, CASE WHEN binding IS NOT NULL AND alpha_t > 2 THEN 'dependent_alpha' WHEN binding IS NOT NULL THEN 'redundant' WHEN alpha_t > 2 THEN 'independent_alpha' ELSE 'independent' END AS outcome FROM oi""",
)
