"""Registered queries of execution arms and order outcomes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators import ledger as O
from panelweave.operators import pnl as L
from panelweave.plans.fixtures import Fixtures
from panelweave.plans.oracle import r
from panelweave.plans.registry import add

BPS, NOTIONAL = 10.0, 20_000.0
_T = "OVER (PARTITION BY book, ticker ORDER BY date)"
_ARMS = {
    "close": ("w1", "ret", "abs(w - w1)"), "open_to_open": ("w1", "oo", "abs(w - w1)"), "intraday": ("w1", "oc", "abs(w - w1)"), "late": ("w2", "ret", "abs(w - w1)"), "whole_shares": ("s1", "ret", "abs(s - s1)"),
}
add(
    "execution_arms", lambda x: L.execution_arms(x.weights, x.returns, x.calendar, BPS, NOTIONAL),
    f"""WITH c AS (SELECT book, date, ticker, CASE WHEN sum(abs(w)) OVER (PARTITION BY book, date) > 2 THEN w * 2 / sum(abs(w)) OVER (PARTITION BY book, date) ELSE w END AS w FROM fx_weights),
    g AS (SELECT b.book, d.date, b.ticker, coalesce(c.w, 0) AS w, open, close, ret FROM (SELECT DISTINCT book, ticker FROM fx_weights) b CROSS JOIN fx_days d LEFT JOIN c ON c.book = b.book AND c.ticker = b.ticker AND c.date = d.date LEFT JOIN fx_returns q ON q.ticker = b.ticker AND q.date = d.date),
    s AS (SELECT *, coalesce(round_even(w * {NOTIONAL} / nullif(close, 0), 0) * close / {NOTIONAL}, 0) AS s, lead(open) {_T} / nullif(open, 0) - 1 AS oo, close / nullif(open, 0) - 1 AS oc FROM g),
    l AS (SELECT *, coalesce(lag(w) {_T}, 0) AS w1, coalesce(lag(w, 2) {_T}, 0) AS w2, coalesce(lag(s) {_T}, 0) AS s1 FROM s),
    a AS ({" UNION ALL ".join(f"SELECT book, date, '{k}' AS arm, {h} * {e} AS e, {t} * {BPS} / 1e4 AS c FROM l" for k, (h, e, t) in _ARMS.items())}),
    d AS (SELECT book, arm, date, coalesce(sum(e), 0) - sum(c) AS net, sum(c) AS c FROM a GROUP BY 1, 2, 3)
    SELECT book, arm, {r("exp(sum(ln(1 + net))) - 1", "total")}, {r("min(net)", "worst")}, {r("sum(c)", "cost")} FROM d GROUP BY 1, 2""",
)


def _with_cancels(x: Fixtures) -> DataFrame:
    """The fills, where every other line of an order that came to nothing was one's own cancel."""
    line = F.element_at(F.split("client_order_id", "-"), 2).cast("int")
    return x.fills.withColumn("status", F.when((F.col("status") == "rejected") & (line % 2 == 0), "canceled").otherwise(F.col("status")))


add(
    "order_outcomes", lambda x: O.order_outcomes(_with_cancels(x)),
    f"""WITH f AS (SELECT session, qty, filled_qty, CASE WHEN status = 'rejected' AND CAST(split_part(client_order_id, '-', 2) AS INTEGER) % 2 = 0 THEN 'canceled' ELSE status END AS status FROM fx_fills),
    g AS (SELECT session, count(*) FILTER (status <> 'canceled') AS n_orders, count(*) FILTER (status <> 'canceled' AND filled_qty > 0) AS n_fills, count(*) FILTER (status = 'partially_filled') AS n_partial, count(*) FILTER (status = 'rejected') AS n_rejects, count(*) FILTER (status = 'canceled') AS n_canceled,
    sum(filled_qty) FILTER (status <> 'canceled') / nullif(sum(qty) FILTER (status <> 'canceled'), 0) AS fill_rate FROM f GROUP BY session)
    SELECT session, n_orders, n_fills, n_partial, n_rejects, n_canceled, {r("fill_rate", "fill_rate")}, {r("CAST(n_rejects AS DOUBLE) / nullif(n_orders, 0)", "reject_rate")}, coalesce(CAST(n_rejects AS DOUBLE) / nullif(n_orders, 0) > 0.1, false) AS alarm FROM g""",
)
