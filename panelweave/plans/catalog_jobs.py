"""Registered queries of sinks, ledgers, event reports, streams, factor and learning jobs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import corr_from_sums
from panelweave.operators import covariance as K
from panelweave.operators import events as V
from panelweave.operators import factors as N
from panelweave.operators import joins as J
from panelweave.operators import ledger as O
from panelweave.operators import pnl as L
from panelweave.operators import rolling as W
from panelweave.operators import state as P
from panelweave.plans import catalog as base
from panelweave.plans.fixtures import Fixtures, cut
from panelweave.plans.oracle import r
from panelweave.plans.registry import add, add_fold
from panelweave.sources import readers as S
from panelweave.streaming import jobs as T
from panelweave.streaming import stateful as Z

DT = ("date", "ticker")

# sinks: written to the shared folder and read back


def _written(x: Fixtures) -> DataFrame:
    at = T.folder(x.spark)
    S.write_panel(x.nets, at)
    return x.spark.read.parquet(at).select("book", "date", "net", "turnover", "year")


def _appended(x: Fixtures) -> DataFrame:
    at, rows = T.folder(x.spark), x.nets.select("book", F.col("date").cast("string").alias("date"), "net")
    S.append_ledger(rows.where("date < '1998-01-01'"), at)
    S.append_ledger(rows.where("date >= '1998-01-01'"), at)
    return x.spark.read.schema("book string, date string, net double").json(at).select("book", F.to_date("date").alias("date"), "net")


def _registered(x: Fixtures) -> DataFrame:
    at = T.folder(x.spark)
    for name in ("lineitem", "orders"):
        S.register(x.spark, at, name, "tables", x.table(name).count(), {"kind": "fixture"}, 2)
    return x.spark.read.json(at).select("name", "source", F.col("rows").cast("long").alias("rows"), F.col("n_trials").cast("int").alias("n_trials"))


def _parts(x: Fixtures) -> DataFrame:
    """The panel written as a training and a holdout part, and both read back under the panel's schema."""
    at = T.folder(x.spark)
    p = x.panel.select("date", "ticker", "open", "close", "volume", "member")
    for name, rows in (("train", p.where("date < '1998-01-01'")), ("holdout", p.where("date >= '1998-01-01'"))):
        rows.write.parquet(f"{at}/{name}")
    return S.read_panel(x.spark, f"{at}/train", f"{at}/holdout")


add("src_panel_parts", _parts, f"SELECT date, ticker, {r('open', 'open')}, {r('close', 'close')}, {r('volume', 'volume')}, member FROM fx_panel")
add("sink_parquet", _written, f"SELECT book, date, {r('net', 'net')}, {r('turnover', 'turnover')}, CAST(year(date) AS INTEGER) AS year FROM fx_nets")
add("sink_ledger_append", _appended, f"SELECT book, date, {r('net', 'net')} FROM fx_nets")
add("lineage_manifest", _registered, "SELECT 'lineitem' AS name, 'tables' AS source, count(*) AS rows, CAST(2 AS INTEGER) AS n_trials FROM lineitem UNION ALL SELECT 'orders', 'tables', count(*), CAST(2 AS INTEGER) FROM orders")

# ledgers and event reports
_MEANS = f"WITH s AS (SELECT ticker, session, {base._SLIP} AS b, row_number() OVER (PARTITION BY ticker ORDER BY session DESC, client_order_id DESC) AS k FROM fx_fills WHERE filled_qty > 0), m AS (SELECT ticker, count(*) AS n, avg(b) AS mean_bps, max(session) >= (SELECT max(session) FROM fx_fills) - 30 AS fresh FROM s WHERE k <= 20 GROUP BY ticker)"
add(
    "slippage_alarms", lambda x: O.slippage_alarms(O.trailing_slippage(x.fills, 20), 3.0, 5, 20).select("ticker", "n", "mean_bps", "alarm"),
    f"{_MEANS} SELECT ticker, n, {r('mean_bps', 'mean_bps')}, CASE WHEN n < 5 THEN 'untested' WHEN NOT fresh THEN 'stale' WHEN abs(mean_bps) > 3 THEN CASE WHEN n < 20 THEN 'provisional_breach' ELSE 'breach' END WHEN n < 20 THEN 'provisional' ELSE 'ok' END AS alarm FROM m",
)
add(
    "paper_stats", lambda x: O.paper_stats(x.nets, L.held(x.weights, x.returns.select("date").distinct()).select("book", *DT, "w"), 8),
    f"WITH n AS (SELECT book, exp(sum(ln(1 + net))) AS nav, max(date) AS date FROM fx_nets GROUP BY book), h AS (SELECT book, nav, ticker, w, CAST(row_number() OVER (PARTITION BY book ORDER BY abs(w) DESC, ticker) AS INTEGER) AS place FROM fx_held0 JOIN n USING (book, date) WHERE w <> 0) SELECT book, {r('nav', 'nav')}, ticker, {r('w', 'w')}, place FROM h WHERE place <= 8",
)
_SG = "CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END"
add(
    "reconcile_exact", lambda x: O.reconcile_exact(x.fills, 20, 60.0),
    f"WITH d AS (SELECT ticker, session, sum({_SG} * (qty - filled_qty)) AS g, sum(CASE WHEN filled_qty > 0 THEN {_SG} * (price - close) * filled_qty ELSE 0 END) AS c FROM fx_fills GROUP BY 1, 2), e AS (SELECT ticker, session, sum(g) OVER (PARTITION BY ticker ORDER BY session) AS gap, sum(c) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS drag FROM d) SELECT ticker, session, {r('gap', 'gap')}, {r('drag', 'drag')}, abs(gap) <= 60 AS settled FROM e",
)
_DX = f"x AS (SELECT f.ticker, {_SG} * (b.open / f.close - 1) * 1e4 AS d, {_SG} * (price - b.open) / f.close * 1e4 AS e FROM fx_fills f LEFT JOIN fx_bars b ON b.ticker = f.ticker AND b.date = f.week WHERE filled_qty > 0), y AS (SELECT *, d IS NOT NULL AND abs(d) <= 150 AS ok FROM x)"
add("drift_exec_split", lambda x: O.drift_exec_split(x.fills, x.few(x.bars.select("ticker", F.col("date").alias("week"), "open")), 150.0), f"WITH {_DX} SELECT ticker, count(*) AS fills, count(*) FILTER (ok) AS split, {r('avg(d) FILTER (ok)', 'drift_bps')}, {r('avg(e) FILTER (ok)', 'exec_bps')} FROM y GROUP BY ticker")
_ICR = f"WITH {base._CAR}, {base._SUE}, j AS (SELECT k, sue AS a, car AS b FROM ca JOIN su ON su.symbol = ca.ticker AND su.period = ca.period WHERE k IN (1, 3, 6) AND sue IS NOT NULL AND car IS NOT NULL), g AS (SELECT k, count(*) AS n, {base._CORR} AS ic FROM j GROUP BY k), h AS (SELECT *, CASE WHEN n >= 3 THEN ic * sqrt(n - 2) / nullif(sqrt(1 - ic * ic), 0) END AS t FROM g)"
add("earnings_ic_report", lambda x: V.ic_report(base._cars(x), V.trailing_sue(x.earnings), [1, 3, 6], 60), f"{_ICR} SELECT k, n, {r('ic', 'ic')}, {r('t', 't')}, CASE WHEN n < 60 THEN 'ACCUMULATING' WHEN t > 2 THEN 'PASS' WHEN t < 0 THEN 'KILL' ELSE 'INDETERMINATE' END AS verdict FROM h")
add(
    "checkpoint_gate", lambda x: V.checkpoint(x.earnings, base._cars(x), 3, 40, 0.2, 0.1),
    f"""WITH {base._CAR}, s AS (SELECT symbol, count(*) AS n FROM fx_earnings GROUP BY 1), rp AS (SELECT e.estimate FROM ca LEFT JOIN fx_earnings e ON e.symbol = ca.ticker AND e.period = ca.period WHERE k = 3 AND car IS NOT NULL),
    o AS (SELECT count(*) AS events, avg(CAST(estimate IS NULL AS DOUBLE)) AS missing, count(DISTINCT symbol) AS names, (SELECT max(n) / sum(n) FROM s) AS largest, (SELECT count(*) FROM rp) AS matured, (SELECT avg(CAST(estimate IS NOT NULL AS DOUBLE)) FROM rp) AS usable,
        CAST(count(*) FILTER (symbol IS NULL OR period IS NULL) + count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, period FROM fx_earnings)) AS BIGINT) AS bad_keys FROM fx_earnings)
    SELECT events, {r('missing', 'missing')}, names, {r('largest', 'largest')}, matured, {r('usable', 'usable')}, bad_keys, coalesce(matured >= 40 AND missing <= 0.1 AND largest <= 0.2 AND bad_keys = 0 AND names >= 5 AND usable >= 0.9, false) AS armed FROM o""",
)

# streams
_rows = lambda x, value: base._events(x).select("user_id", "ts", "event_id", value.alias("v"))
_Z = lambda: (F.col("value") - 60) / 30
_OV = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
add(
    "st_bands", lambda x: T.settle(Z.state_machine(_rows(x, _Z()), "user_id", "v", (0,), "p int", Z.bands(1.25, 0.5))),
    f"WITH a AS (SELECT user_id, event_id, ts, (value - 60) / 30 AS v FROM events), b AS (SELECT *, sum(CAST(abs(v) <= 0.5 AS INTEGER)) {_OV} AS seg, CASE WHEN abs(v) <= 0.5 THEN NULL WHEN v >= 1.25 THEN -1 WHEN v <= -1.25 THEN 1 END AS e FROM a) SELECT user_id, event_id, CAST(CASE WHEN abs(v) <= 0.5 THEN 0 ELSE coalesce(first_value(e IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) END AS INTEGER) AS out FROM b",
)
_COUNT = f"WITH a AS (SELECT *, {{hit}} AS h FROM events{{where}}), b AS (SELECT *, sum(CAST(NOT h AS INTEGER)) {_OV} AS seg FROM a) SELECT user_id, event_id, CAST(sum(CAST(h AS INTEGER)) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS out FROM b"
add("st_halt_counter", lambda x: T.settle(Z.state_machine(_rows(x, F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), "user_id", "v", (0,), "n int", Z.counter(lambda v: v > 0))), _COUNT.format(hit="event_type = 'error'", where=""))
add("st_breach_streak", lambda x: T.settle(Z.state_machine(_rows(x, F.when(F.col("event_type") != "view", F.abs(F.col("value") - 60))), "user_id", "v", (0,), "n int", Z.counter(lambda v: v > 30))).join(x.table("events").where("event_type <> 'view'").select("event_id"), "event_id", "left_semi"), _COUNT.format(hit="abs(value - 60) > 30", where=" WHERE event_type <> 'view'"))
add(
    "st_alert_on_change", lambda x: T.settle(Z.state_machine(_rows(x, (F.col("value") > 60).cast("int").cast("double")), "user_id", "v", (-1,), "last int", Z.on_change)),
    "WITH a AS (SELECT user_id, event_id, CAST(value > 60 AS INTEGER) AS out, lag(CAST(value > 60 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, out FROM a WHERE p IS NULL OR p <> out",
)
add(
    "st_embargo_append", lambda x: T.settle(Z.finished_days(base._events(x), "event_type", "value", "10 days")).withColumn("day", F.to_date("day")),
    "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS BIGINT) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1, 2",
)
add(
    "st_order_fill_interval", lambda x: T.settle(Z.interval_join(base._events(x).where("event_type = 'click'"), base._events(x).where("event_type = 'purchase'"), "user_id", "6 hours")),
    "SELECT o.user_id, o.event_id AS order_id, f.event_id AS fill_id FROM events o JOIN events f ON o.user_id = f.user_id AND o.event_type = 'click' AND f.event_type = 'purchase' AND f.ts >= o.ts AND f.ts <= o.ts + INTERVAL 6 HOUR",
)

# factor structure
_window = lambda x: K.window_rows(x.returns, 26)
_load = lambda x: N.loadings(_window(x), 3)
add(
    "residualize_window", lambda x: N.residualize_window(_window(x), x.market).groupBy("month", "ticker").agg(F.count("*").alias("n"), F.stddev_samp("ret").alias("sd")),
    f"""WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM fx_days), f AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(pos) AS at_ FROM d GROUP BY 1 HAVING min(pos) > 26), w AS (SELECT month, d.date, ticker, ret, count(*) OVER (PARTITION BY month, ticker) AS c FROM f JOIN d ON pos BETWEEN at_ - 26 AND at_ - 1 JOIN fx_returns USING (date) WHERE ret IS NOT NULL),
    x AS (SELECT month, date, ticker, w.ret, m.ret AS m FROM w JOIN fx_market m USING (date) WHERE c = 26 AND m.ret IS NOT NULL), z AS (SELECT *, (ret - avg(ret) OVER q) / nullif(stddev_samp(ret) OVER q, 0) AS z, avg(m) OVER q AS mm FROM x WINDOW q AS (PARTITION BY month, ticker)), b AS (SELECT *, covar_pop(z, m) OVER q / nullif(var_pop(m) OVER q, 0) AS b FROM z WINDOW q AS (PARTITION BY month, ticker))
    SELECT month, ticker, count(*) AS n, {r('stddev_samp(z - b * (m - mm))', 'sd')} FROM b GROUP BY 1, 2""",
)
add("rolling_pca", lambda x: N.project(_load(x), x.returns).select("month", "date", "factor", F.abs("score").alias("score")))
add("factor_vetting", lambda x: N.vetting(_load(x), 0.15, 0.4))
add("subspace_average", lambda x: N.subspace_average(_load(x), 6, 3))
add("pc_to_signal_weights", lambda x: N.signal_weights(_load(x), N.project(_load(x), x.returns).groupBy("month", "factor").agg(F.avg("score").alias("tilt"))))
add("factor1_hedge", lambda x: W.residual(x.returns.select(*DT, "ret").join(N.project(_load(x).where("factor = 1"), x.returns).select("date", F.col("score").alias("f")), "date"), 13).select(*DT, "resid", "hedged"))
for _how in ("constant_correlation", "clip"):
    add(f"minvar_weights_{_how}", lambda x, how=_how: K.min_variance(_window(x), how))
_EDGE = f"ed AS (SELECT a0, b0 FROM ({base._PC}) GROUP BY a0, b0 HAVING {base._CORR} > 0.35)"
_clusters = lambda x: N.clusters(J.pairs(x.returns.where("ret is not null"), "ticker", None, "date", value="ret").groupBy("a", "b").agg(corr_from_sums(F.col("va"), F.col("vb")).alias("c")).where("c > 0.35"), x.returns.select("ticker"), cut)
add_fold(
    "corr_clusters", _clusters,
    f"WITH {_EDGE}, bo AS (SELECT a0 AS a, b0 AS b FROM ed UNION SELECT b0, a0 FROM ed), re AS (SELECT DISTINCT ticker, ticker AS seen FROM fx_returns UNION SELECT re.ticker, bo.b FROM re JOIN bo ON bo.a = re.seen) SELECT ticker, min(seen) AS cluster FROM re GROUP BY ticker",
)
add_fold(
    "cluster_signs", lambda x: N.cluster_signs(_clusters(x), x.returns),
    f"""WITH {_EDGE}, bo AS (SELECT a0 AS a, b0 AS b FROM ed UNION SELECT b0, a0 FROM ed), re AS (SELECT DISTINCT ticker, ticker AS seen FROM fx_returns UNION SELECT re.ticker, bo.b FROM re JOIN bo ON bo.a = re.seen), cl AS (SELECT ticker, min(seen) AS cluster FROM re GROUP BY ticker),
    me AS (SELECT ticker, avg(ret) AS m FROM fx_returns WHERE ret IS NOT NULL GROUP BY ticker), g AS (SELECT cluster, count(*) AS names, count(*) FILTER (m > 0) AS up, median(m) AS median FROM me JOIN cl USING (ticker) GROUP BY cluster)
    SELECT cluster, names, up, {r('median', 'median')}, {r('least(1, 2 * list_sum(list_transform(range(0, least(up, names - up) + 1), lambda i: exp(lgamma(names + 1) - lgamma(i + 1) - lgamma(names - i + 1)))) / pow(2, names))', 'p')} FROM g""",
)

# grids and learning
add("drift_rebalance_grid", lambda x: N.drift_grid(x.weights, x.returns.select(*DT, "ret"), [0.1, 0.5], [1.0, 1.5]))


def _candidates(x: Fixtures) -> DataFrame:
    s = base._s(x).select(*DT, "s", "close")
    return s.select(*DT, F.when(F.col("s") <= -1.25, F.col("s")).alias("depth"), F.coalesce(F.col("s") >= 0, F.lit(False)).alias("leave"), F.col("close").isNotNull().alias("priced"))


add("slot_allocator", lambda x: N.slot_grid(_candidates(x), [3, 8], [4, 13]))


def _entries(x: Fixtures) -> DataFrame:
    """Trades of the residual book with what was known at entry: (ticker, start, end, pnl, s, vol, sector)."""
    t = P.trades(base._bands(x))
    known = W.realized_vol(base._s(x), 8, 52).select("ticker", F.col("date").alias("start"), "s", "vol", "sector")
    return t.select("ticker", "start", "end", "pnl").join(known, ["ticker", "start"])


_SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
add("meta_features", lambda x: N.meta_features(_entries(x).drop("pnl", "end"), ["s", "vol"], "sector", _SECTORS))


def _scored(x: Fixtures) -> DataFrame:
    f = N.meta_features(_entries(x), ["s", "vol"], "sector", _SECTORS)
    f = f.select(F.col("start").alias("date"), "ticker", F.date_add("end", 7).alias("known"), "pnl", (F.col("pnl") > 0).cast("int").alias("y"), F.array("s", "vol", *[c for c in f.columns if c.startswith("is_")]).alias("x"))
    f = cut(f)
    return N.walk_forward_logit(f, 20, 5).join(f.select("date", "ticker", "pnl"), ["date", "ticker"])


add("walk_forward_oof", lambda x: N.auc(_scored(x), "fold"))
add("gate_positions", lambda x: N.gate_positions(_scored(x).select("ticker", F.col("date").alias("start"), "p", "pnl"), 0.6, 0.7))
