"""The books over the panel, with SQL twins where a window or a join can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import covariance as K
from panelweave.plans import books_panel as B
from panelweave.plans import catalog as base
from panelweave.plans.books import BOOKS
from panelweave.plans.oracle import lag, mean, r, roll, std
from panelweave.plans.registry import add

_T = "PARTITION BY ticker ORDER BY date"
_TRANCHE = " + ".join(f"coalesce(last_value(CASE WHEN pos % 4 = {k} THEN w0 END IGNORE NULLS) OVER ({_T} ROWS UNBOUNDED PRECEDING), 0)" for k in range(4))
add(
    "book_momentum_concentrated",
    lambda x: BOOKS["momentum_concentrated"](x.returns, x.market),
    f"""WITH m0 AS (SELECT date, ticker, mom, ({std("ret", 8)}) * sqrt(52.0) AS vol, member FROM fx_mom), m1 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS k FROM m0 WHERE member AND mom IS NOT NULL AND vol > 0),
    m2 AS (SELECT date, ticker, 1 / vol / sum(1 / vol) OVER (PARTITION BY date) AS w, count(*) OVER (PARTITION BY date) AS n FROM m1 WHERE k <= 5), m3 AS (SELECT DISTINCT date FROM m2 WHERE n = 5),
    m4 AS (SELECT p.date, p.ticker, p.ret, c.pos, CASE WHEN m3.date IS NOT NULL THEN coalesce(m2.w, 0) END AS w0 FROM fx_returns p JOIN fx_calendar c USING (date) LEFT JOIN m3 ON m3.date = p.date LEFT JOIN m2 ON m2.date = p.date AND m2.ticker = p.ticker AND m2.n = 5),
    m5 AS (SELECT date, ticker, ret, ({_TRANCHE}) / 4 AS w FROM m4), m6 AS (SELECT date, sum(e) AS net FROM (SELECT date, {lag("w")} * ret AS e FROM m5) GROUP BY date),
    m7 AS (SELECT date, round(({roll("stddev_samp(net)", "net", 8, "1")}) * sqrt(52.0), 12) AS v FROM m6),
    m8 AS (SELECT date, mkt < ({mean("mkt", 40, "1")}) AS bear FROM fx_macro), m9 AS (SELECT date, CASE WHEN v > 0 THEN least(greatest(0.02 / v, 0.5), 2) ELSE 1 END AS lev FROM m7),
    n0 AS (SELECT date, ticker, w * CASE WHEN coalesce(bear, false) THEN least(lev, 1) ELSE lev END AS w FROM m5 JOIN m9 USING (date) JOIN m8 USING (date)), n1 AS (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS g FROM n0)
    SELECT date, ticker, {r("CASE WHEN g > 2 THEN w * 2 / g ELSE w END", "w")} FROM n1 WHERE w <> 0""",
)
_ROWS = f"({_T} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)"
_GAP = f"""g0 AS (SELECT *, CASE WHEN count(ret) OVER {_ROWS} = 13 THEN stddev_samp(ret) OVER {_ROWS} END AS sd, {roll("median(volume)", "volume", 8)} AS mv FROM fx_returns),
    g1 AS (SELECT *, CAST(coalesce(member AND ret > 1.5 * sd AND volume >= lag(mv) OVER ({_T}), false) AS INTEGER) AS event FROM g0),
    g2 AS (SELECT date, ticker, CASE WHEN close IS NOT NULL THEN coalesce(max(event) OVER ({_T} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS active FROM g1), g3 AS (SELECT *, sum(active) OVER (PARTITION BY date) AS n FROM g2)"""
add(
    "book_gap_drift",
    lambda x: BOOKS["gap_drift"](x.returns),
    f"""WITH {_GAP} SELECT date, ticker, {r("least(CAST(1 AS DOUBLE) / n, 0.2) * 1.5", "w")} FROM g3 WHERE active = 1
    UNION ALL SELECT date, 'MKT', {r("1.5 - CASE WHEN any_value(n) > 0 THEN least(1, any_value(n) * CAST(0.2 AS DOUBLE)) ELSE 0 END * 1.5", "w")} FROM g3 GROUP BY date""",
)
_MASK = "month(date) IN (1, 4, 7, 10)"
_RUN = f"""{base._BANDS}, q0 AS (SELECT * EXCLUDE (position), ({roll("median(close * volume)", "close * volume", 8)}) AS adv, position AS p0 FROM p3), q1 AS (SELECT *, CASE WHEN NOT member OR coalesce(adv < 20000, false) THEN 0 ELSE p0 END AS position FROM q0),
    q2 AS (SELECT *, {_MASK} AS mask, coalesce(position <> lag(position) OVER ({_T}), true) AS new FROM q1), q3 AS (SELECT *, sum(CAST(new AS INTEGER)) OVER ({_T}) AS run FROM q2),
    q4 AS (SELECT * EXCLUDE (position), CASE WHEN max(CAST(NOT mask AS INTEGER)) OVER (PARTITION BY ticker, run ORDER BY date ROWS UNBOUNDED PRECEDING) = 1 THEN position ELSE 0 END AS position FROM q3),
    w1 AS (SELECT *, coalesce(CAST(position AS DOUBLE) / nullif(sum(abs(position)) OVER (PARTITION BY date), 0), 0) AS w0 FROM q4), w2 AS (SELECT *, greatest(-0.08, least(0.08, w0)) AS c FROM w1), w3 AS (SELECT *, abs(sum(c) OVER (PARTITION BY date, sector)) AS sn FROM w2),
    w4 AS (SELECT *, CASE WHEN sn > 0.1 THEN c * 0.1 / sn ELSE c END AS capped FROM w3), w5 AS (SELECT *, coalesce(capped / nullif(sum(abs(capped)) OVER (PARTITION BY date), 0), 0) AS w FROM w4),
    w6 AS (SELECT date, lag(w, 2) OVER ({_T}) * hedged AS e, abs(w - lag(w) OVER ({_T})) AS t, w * coalesce(lag(beta) OVER ({_T}), 0) AS o, ticker FROM w5), w7 AS (SELECT *, abs(o - coalesce(lag(o) OVER ({_T}), 0)) AS d FROM w6),
    w8 AS (SELECT date, coalesce(sum(e), 0) AS gross, coalesce(sum(t), 0) * 0.001 + sum(d) * 0.001 AS cost FROM w7 GROUP BY date), w9 AS (SELECT *, gross - cost AS net FROM w8), y0 AS (SELECT *, sum(CAST(abs(net) > 1e-15 AS INTEGER)) OVER (ORDER BY date) AS live FROM w9)"""
add("run_residual", lambda x: B.run_residual(x.factor, blackout=F.month("date").isin(1, 4, 7, 10)), f"WITH {_RUN} SELECT date, {r('gross', 'gross')}, {r('cost', 'cost')}, {r('net', 'net')} FROM y0 WHERE live > 0")
_index = lambda x: x.macro.select("date", F.col("volx").alias("v"))
add("book_ew_levered_gate", lambda x: B.levered_gate(x.returns, _index(x), 1.0))
add("book_deep_dip", lambda x: B.deep_dip(x.factor))
add("book_composite", lambda x: B.composite(x.returns, _index(x)))
for _how in ("identity", "sample"):
    add(f"book_minvar_{_how}", lambda x, how=_how: B.monthly_min_variance(K.min_variance(K.window_rows(x.returns, 26), how), x.calendar))
_PAIR = "PARTITION BY k, a, b ORDER BY date"
add(
    "run_pairs_walk_forward",
    lambda x: B.walk_forward_pairs(x.returns, x.calendar.select("date", "pos")),
    f"""WITH v AS (SELECT unnest(range(0, (SELECT CAST(floor((max(pos) - 1 - 26) / 13) AS BIGINT) FROM fx_calendar) + 1)) AS k), d AS (SELECT k, date, pos - 1 < k * 13 + 26 AS forming FROM fx_calendar JOIN v ON pos - 1 >= k * 13 AND pos - 1 < k * 13 + 39),
    x AS (SELECT k, date, forming, ticker, sector, close, ret FROM fx_returns JOIN d USING (date) WHERE close IS NOT NULL), f AS (SELECT *, close / first_value(close) OVER (PARTITION BY k, ticker ORDER BY date) AS p FROM x WHERE forming),
    s AS (SELECT a.k, a.ticker AS a, b.ticker AS b, round(avg(pow(a.p - b.p, 2)), 9) AS ssd FROM f a JOIN f b ON a.k = b.k AND a.date = b.date AND a.sector = b.sector AND a.ticker < b.ticker GROUP BY 1, 2, 3),
    c AS (SELECT k, a, b FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY ssd, a, b) <= 5), y AS (SELECT c.k, c.a, c.b, l.date, l.forming, ln(l.close) - ln(m.close) AS spread, l.ret AS ra, m.ret AS rb FROM c JOIN x l ON l.k = c.k AND l.ticker = c.a JOIN x m ON m.k = c.k AND m.ticker = c.b AND m.date = l.date),
    g AS (SELECT k, a, b, avg(spread) AS m, stddev_samp(spread) AS s FROM y WHERE forming GROUP BY 1, 2, 3), z AS (SELECT y.*, (spread - m) / nullif(s, 0) AS z FROM y JOIN g USING (k, a, b) WHERE NOT forming),
    p1 AS (SELECT *, coalesce(abs(z) <= 0.5, false) AS flat FROM z), p2 AS (SELECT *, sum(CAST(flat AS INTEGER)) OVER ({_PAIR} ROWS UNBOUNDED PRECEDING) AS seg, CASE WHEN flat THEN NULL WHEN z >= 1.25 THEN -1 WHEN z <= -1.25 THEN 1 END AS e FROM p1),
    p3 AS (SELECT *, CASE WHEN flat THEN 0 ELSE coalesce(first_value(e IGNORE NULLS) OVER (PARTITION BY k, a, b, seg ORDER BY date ROWS UNBOUNDED PRECEDING), 0) END AS position FROM p2),
    p4 AS (SELECT *, coalesce(lag(position) OVER ({_PAIR}), 0) AS h, lag(date) OVER ({_PAIR}) AS before FROM p3)
    SELECT date, count(*) AS pairs, {r("avg(coalesce(h * (ra - rb), 0) - CASE WHEN before IS NULL THEN 0 ELSE abs(position - h) END * 0.002)", "net")} FROM p4 GROUP BY date""",
)
