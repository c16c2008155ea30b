"""Every registered query of the research operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, rolling_median
from panelweave.operators import bars as B
from panelweave.operators import cross_section as C
from panelweave.operators import events as V
from panelweave.operators import joins as J
from panelweave.operators import ledger as O
from panelweave.operators import metrics as M
from panelweave.operators import pnl as L
from panelweave.operators import rolling as W
from panelweave.operators import state as P
from panelweave.operators import universe as U
from panelweave.plans.oracle import lag, mean, r, roll, std, total
from panelweave.plans.registry import add, add_fold, alias, oracle_sql, queries  # noqa: F401
from panelweave.sources import readers as S

DT = ("date", "ticker")

# sources and sinks
add("src_parquet_panel", lambda x: x.bars.where("date < date'1998-01-01'").unionByName(x.bars.where("date >= date'1998-01-01'")), f"SELECT date, ticker, {r('open', 'open')}, {r('close', 'close')}, volume, n FROM fx_bars")
add(
    "src_csv_factors",
    lambda x: S.parse_factors(x.returns.groupBy("date").agg(F.round(F.avg("ret") * 100, 6).alias("v")).select(F.concat(F.lit(" "), F.date_format("date", "yyyyMMdd"), F.lit(" ,"), F.col("v").cast("decimal(20,6)").cast("string")).alias("value")).unionByName(x.bars.select(F.concat(F.lit("note "), F.col("ticker")).alias("value")).distinct()), ["mkt"]),
    f"SELECT date, {r('round(avg(ret) * 100, 6) / 100', 'mkt')} FROM fx_returns GROUP BY date HAVING avg(ret) IS NOT NULL",
)
add(
    "src_jsonl_ledger",
    lambda x: S.parse_ledger(x.table("events").select(F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("props")).alias("value")), "k long").groupBy("k", "torn").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 7 = 0 AS torn, count(*) AS n FROM events WHERE event_id % 7 = 0 OR event_id % 11 <> 0 GROUP BY 1, 2",
)
add(
    "src_change_log",
    lambda x: S.parse_changes(x.changes.select(F.concat(F.col("date").cast("string"), F.lit(',"'), F.array_join(F.transform(F.reverse("members"), lambda m: F.concat(F.lit(" $"), F.lower(m))), ","), F.lit('"')).alias("value"))).select("date", F.array_join("members", ",").alias("members")),
    "SELECT date, array_to_string(members, ',') AS members FROM fx_changes",
)
add(
    "src_xbrl_assets",
    lambda x: S.annual_facts(x.earnings.select(F.col("symbol").alias("ticker"), F.to_date(F.date_trunc("year", "period")).alias("fy_end"), F.when(F.month("period") == 4, "10-Q").otherwise("10-K").alias("form"), F.lit("FY").alias("fp"), F.col("report_date").alias("filed"), F.col("actual").alias("assets"))),
    f"SELECT symbol AS ticker, CAST(date_trunc('year', period) AS DATE) AS fy_end, {r('arg_max(actual, report_date)', 'assets')}, count(*) AS filings FROM fx_earnings WHERE month(period) <> 4 GROUP BY 1, 2",
)
_NEWS = "SELECT ts AS created_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS headline FROM events"
add(
    "src_news_explode",
    lambda x: S.explode_news(x.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).select(F.col("ts").alias("created_at"), F.array(F.concat(F.lit("E"), F.col("k") % 25), F.concat(F.lit("E"), F.col("k") % 7)).alias("symbols"), F.col("event_type").alias("headline"))).select("date", "ticker", "headline", "copies"),
    f"SELECT CAST(created_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS date, ticker, headline, count(*) AS copies FROM (SELECT created_at, headline, unnest(['E' || (k % 25), 'E' || (k % 7)]) AS ticker FROM ({_NEWS})) GROUP BY 1, 2, 3",
)
add("src_constituents", lambda x: S.constituents(x.sectors.select(F.concat(F.lit(" $"), F.lower("ticker")).alias("symbol"), F.col("sector").alias("gics_sector"), "company").unionByName(x.sectors.select(F.col("ticker").alias("symbol"), F.col("sector").alias("gics_sector"), F.concat(F.col("company"), F.lit("z")).alias("company")))), "SELECT ticker, sector, company FROM fx_sectors")
add(
    "sink_replace_by_key",
    lambda x: O.replace_by_key(x.nets.select("book", "date", "net"), x.nets.where("book = 'bk_ew' and date >= date'2000-01-01'").select("book", "date", (F.col("net") * 2).alias("net")), ["book", "date"]),
    f"SELECT book, date, {r('CASE WHEN book = ' + chr(39) + 'bk_ew' + chr(39) + ' AND date >= DATE ' + chr(39) + '2000-01-01' + chr(39) + ' THEN 2 * net ELSE net END', 'net')} FROM fx_nets",
)
add(
    "sink_write_once",
    lambda x: O.append_new(x.nets.where("date < date'2000-01-01'").select("book", "date", "net"), x.nets.where("date >= date'1999-06-01'").select("book", "date", (F.col("net") * 2).alias("net")), ["book"], "date"),
    f"SELECT book, date, {r('CASE WHEN date <= max(CASE WHEN date < DATE ' + chr(39) + '2000-01-01' + chr(39) + ' THEN date END) OVER (PARTITION BY book) THEN net ELSE 2 * net END', 'net')} FROM fx_nets",
)

# validation, universe, filters
add(
    "validate_panel", lambda x: U.validate_panel(x.prints.select(F.to_date("ts").alias("date"), "ticker")),
    "WITH k AS (SELECT CAST(ts AS DATE) AS date, ticker, count(*) AS n FROM fx_prints GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n > 1) AS n_duplicate_keys, CAST(coalesce(sum(n) FILTER (date IS NULL OR ticker IS NULL), 0) AS BIGINT) AS n_null_keys, count(*) FILTER (n > 1) = 0 AND sum(n) > 0 AS ok FROM k",
)
add("validate_signal_panel", lambda x: U.validate_signals(x.signals.withColumnRenamed("signalname", "signal_id").withColumn("ret", F.when(F.col("ret") != 0, F.col("ret"))), "signal_id"), f"SELECT signalname, date, {r('ret', 'ret')} FROM fx_signals WHERE ret <> 0")
add("ls_portfolio_filter", lambda x: U.long_short(x.signals, "1998-01-01"), f"SELECT signalname, date, {r('ret / 100', 'ret')} FROM fx_signals WHERE port = 'LS' AND date >= DATE '1998-01-01'")
add("clean_ticker", lambda x: x.table("part").select("p_partkey", U.clean_ticker(F.concat(F.lit(" $"), F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit(" "))).alias("ticker")), "SELECT p_partkey, replace(replace(upper(trim(' $' || replace(p_brand, '#', '.') || ' ')), '.', '-'), '$', '') AS ticker FROM part")
add("membership_mask", lambda x: x.panel.select(*DT, "member"), "SELECT date, ticker, member FROM fx_panel")
add("ever_members", lambda x: U.ever_members(x.changes), "SELECT DISTINCT unnest(members) AS ticker FROM fx_changes")
add("missing_members", lambda x: U.missing_members(x.changes, x.bars.where("ticker > 'N05'"), "1999-01-01"), "SELECT DISTINCT ticker FROM (SELECT unnest(members) AS ticker FROM fx_changes WHERE date >= DATE '1999-01-01') WHERE ticker NOT IN (SELECT ticker FROM fx_bars WHERE ticker > 'N05')")
_VARIANTS = "SELECT ticker, unnest([ticker, substr(ticker, 1, 2), ticker || 'Q', replace(ticker, '-', '.'), 'N' || substr(ticker, 2, 9)]) AS variant, unnest([0, 1, 2, 3, 4]) AS p FROM s"
add(
    "rename_candidates", lambda x: U.rename_candidates(x.sectors.select(F.when(F.substring("ticker", 3, 1) > "4", F.concat(F.lit("X"), F.substring("ticker", 2, 2))).otherwise(F.col("ticker")).alias("ticker")).unionByName(x.sectors.select(F.concat(F.lit("Y"), F.col("ticker")).alias("ticker"))), x.sectors),
    f"WITH s AS (SELECT CASE WHEN substr(ticker, 3, 1) > '4' THEN 'X' || substr(ticker, 2, 2) ELSE ticker END AS ticker FROM fx_sectors UNION ALL SELECT 'Y' || ticker FROM fx_sectors), v AS ({_VARIANTS}), k AS (SELECT v.ticker, arg_min(variant, p) AS match, min(p) AS priority FROM v JOIN fx_sectors f ON f.ticker = v.variant GROUP BY 1) SELECT s.ticker, match, priority, CASE WHEN match IS NULL THEN 'unresolved' WHEN priority = 0 THEN 'same' ELSE 'renamed' END AS event FROM s LEFT JOIN k USING (ticker)",
)
add("coverage_audit", lambda x: U.coverage(x.panel), f"SELECT ticker, count(*) FILTER (member) AS member_days, count(*) FILTER (member AND close IS NOT NULL) AS priced_days, {r('CAST(count(*) FILTER (member AND close IS NOT NULL) AS DOUBLE) / nullif(count(*) FILTER (member), 0)', 'ratio')} FROM fx_panel GROUP BY ticker")
add("liquidity_filter", lambda x: U.liquidity_filter(B.dollar_adv(x.panel, 8).withColumn("position", F.lit(1)).select(*DT, "position", (F.col("adv") / 1000).alias("adv")), 20.0), f"WITH a AS (SELECT date, ticker, ({roll('median(close * volume)', 'close * volume', 8)}) / 1000 AS adv FROM fx_panel) SELECT date, ticker, CASE WHEN adv < 20 THEN 0 ELSE 1 END AS position, {r('adv', 'adv')}, coalesce(adv < 20, false) AS removed FROM a")
add(
    "earnings_window_mask", lambda x: U.event_window(x.calendar, x.earnings.select(F.col("symbol").alias("ticker"), F.col("report_date").alias("event_date")), 2, 1),
    "WITH e AS (SELECT symbol AS ticker, report_date, (SELECT min(pos) FROM fx_calendar c WHERE c.date >= report_date) AS at FROM fx_earnings) SELECT DISTINCT c.date, e.ticker FROM e JOIN fx_calendar c ON c.pos BETWEEN e.at - 2 AND e.at + 1",
)
add("earnings_blackout_calendar", lambda x: U.calendar_blackout(x.calendar.select("date"), x.earnings.select(F.col("symbol").alias("ticker"), F.col("report_date").alias("event_date")), 10), "SELECT DISTINCT date, symbol AS ticker FROM fx_days JOIN fx_earnings ON date BETWEEN report_date - 10 AND report_date + 10")
add("pit_zeroing", lambda x: U.pit_zero(x.panel.withColumn("position", F.lit(1))).select(*DT, "position"), "SELECT date, ticker, CASE WHEN member THEN 1 ELSE 0 END AS position FROM fx_panel")
add("clip_returns", lambda x: U.clip_returns(x.returns.select(*DT, "ret"), -0.01, 0.02), f"SELECT date, ticker, {r('CASE WHEN ret IS NOT NULL THEN greatest(-0.01, least(0.02, ret)) END', 'ret')} FROM fx_returns")
add("min_cross_section", lambda x: U.min_cross_section(x.returns.select(*DT, F.col("ret").alias("score")), 20), f"SELECT date, ticker, {r('ret', 'score')} FROM (SELECT *, count(ret) OVER (PARTITION BY date) AS k FROM fx_returns) WHERE k >= 20")
add("universe_integrity", lambda x: U.integrity(x.panel), "SELECT date, count(*) AS expected, count(close) AS priced, count(close) >= 0.9 * count(*) AS ok FROM fx_panel WHERE member GROUP BY date")
add("signal_only_guard", lambda x: U.signal_only_violations(x.weights, ["N03", "N07"]), f"SELECT book, date, ticker, {r('w', 'w')} FROM fx_weights WHERE ticker IN ('N03', 'N07') AND w <> 0")

# bars, returns, calendars
add("daily_returns", lambda x: x.returns.select(*DT, "ret"), f"SELECT date, ticker, {r('ret', 'ret')} FROM fx_returns")
_PAD = "SELECT date, ticker, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM fx_panel"
add("daily_returns_padded", lambda x: B.daily_returns(x.panel, pad=True).select(*DT, "ret"), f"WITH h AS ({_PAD}) SELECT date, ticker, {r('p / ' + lag('p') + ' - 1', 'ret')} FROM h")
add("stale_mark", lambda x: L.stale_mark(x.panel).select(*DT, "ret"), f"WITH h AS ({_PAD}) SELECT date, ticker, {r('p / ' + lag('p') + ' - 1', 'ret')} FROM h")
_FIRST = "first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
add("normalize_prices", lambda x: B.normalize(x.panel).select(*DT, "norm"), f"SELECT date, ticker, {r('close / ' + _FIRST, 'norm')} FROM fx_panel")
add("overnight_intraday", lambda x: B.overnight_intraday(x.panel).select(*DT, "overnight", "intraday"), f"SELECT date, ticker, {r('open / ' + lag('close') + ' - 1', 'overnight')}, {r('close / open - 1', 'intraday')} FROM fx_panel")
add("dollar_adv", lambda x: B.dollar_adv(x.panel, 8).select(*DT, (F.col("adv") / 1000).alias("adv_thousands")), f"SELECT date, ticker, {r('(' + roll('median(close * volume)', 'close * volume', 8) + ') / 1000', 'adv_thousands')} FROM fx_panel")
add("volume_ratio", lambda x: B.volume_ratio(x.panel, 8).select(*DT, "volume_ratio"), f"SELECT date, ticker, {r('volume / (' + mean('volume', 8) + ')', 'volume_ratio')} FROM fx_panel")
add("resample_month", lambda x: B.resample(x.returns), f"SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, {r('arg_max(close, date) FILTER (close IS NOT NULL)', 'close')}, sum(volume) AS volume, {r('exp(sum(ln(1 + coalesce(ret, 0)))) - 1', 'ret')}, count(close) AS n FROM fx_returns GROUP BY 1, 2")
add("rebalance_calendar", lambda x: x.calendar, "SELECT * FROM fx_calendar")
add(
    "hold_until_rebalance", lambda x: B.hold_until(x.weights.where("book = 'bk_rot'").join(x.calendar.where("month_first").select("date"), "date", "left_semi").select("date", "ticker", "w"), x.calendar.select("date")),
    f"WITH m AS (SELECT w.* FROM fx_weights w JOIN fx_calendar c USING (date) WHERE book = 'bk_rot' AND month_first), k AS (SELECT date AS start, lead(date) OVER (ORDER BY date) AS stop FROM (SELECT DISTINCT date FROM m)) SELECT d.date, m.ticker, {r('m.w', 'w')} FROM fx_days d JOIN k ON d.date >= k.start AND (k.stop IS NULL OR d.date < k.stop) JOIN m ON m.date = k.start",
)
add("densify", lambda x: x.panel.select(*DT, "close"), f"SELECT date, ticker, {r('close', 'close')} FROM fx_panel")
add(
    "union_extend_panel", lambda x: B.extend(x.panel.where("date < date'1999-01-01'").select(*DT, F.when(F.col("ticker") != "N03", F.col("close")).alias("close")), x.panel.where("date >= date'1998-01-01'").select(*DT, (F.col("close") + 1).alias("close"))),
    f"SELECT date, ticker, {r('CASE WHEN date < DATE ' + chr(39) + '1998-01-01' + chr(39) + ' THEN CASE WHEN ticker <> ' + chr(39) + 'N03' + chr(39) + ' THEN close END WHEN date < DATE ' + chr(39) + '1999-01-01' + chr(39) + ' AND ticker <> ' + chr(39) + 'N03' + chr(39) + ' THEN coalesce(close, close + 1) ELSE close + 1 END', 'close')} FROM fx_panel",
)
_LAST = "last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
add("ffill_heal", lambda x: B.heal(x.panel, ["N01", "N02", "N09"]).select(*DT, "close"), f"SELECT date, ticker, {r('CASE WHEN ticker IN (' + chr(39) + 'N01' + chr(39) + ', ' + chr(39) + 'N02' + chr(39) + ', ' + chr(39) + 'N09' + chr(39) + ') THEN ' + _LAST + ' ELSE close END', 'close')} FROM fx_panel")
add("split_by_cut", lambda x: B.split_by_cut(x.panel, "1999-12-31").groupBy("part").agg(F.count("*").alias("n"), F.count("close").alias("priced")), "SELECT CASE WHEN date <= DATE '1999-12-31' THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, count(close) AS priced FROM fx_panel GROUP BY 1")
add("log_return_window", lambda x: B.log_returns(x.panel).select(*DT, "log_ret"), f"SELECT date, ticker, {r('ln(close) - ' + lag('ln(close)'), 'log_ret')} FROM fx_panel")

# joins
add("join_inner_align", lambda x: x.weights.join(x.returns.select(*DT, "ret"), list(DT)).where("ret is not null"), f"SELECT date, ticker, book, {r('w', 'w')}, {r('ret', 'ret')} FROM fx_weights JOIN fx_returns USING (date, ticker) WHERE ret IS NOT NULL")
add("join_left_reactions", lambda x: x.earnings.select("symbol", "period", "actual").join(x.earnings.where("point_in_time").select("symbol", "period", F.lit(True).alias("seen")), ["symbol", "period"], "left"), f"SELECT symbol, period, {r('actual', 'actual')}, CASE WHEN point_in_time THEN true END AS seen FROM fx_earnings")
add(
    "join_outer_panels", lambda x: x.bars.select(*DT, F.col("close").alias("a")).join(x.returns.where("member and ret is not null").select(*DT, F.col("ret").alias("b")), list(DT), "full"),
    f"SELECT date, ticker, {r('a', 'a')}, {r('b', 'b')} FROM (SELECT date, ticker, close AS a FROM fx_bars) FULL JOIN (SELECT date, ticker, ret AS b FROM fx_returns WHERE member AND ret IS NOT NULL) USING (date, ticker)",
)
add("map_sector_factor", lambda x: x.factor.select(*DT, F.when(F.col("sector") == "ASIA", F.col("m")).otherwise(F.coalesce("f", "m")).alias("factor")), f"SELECT date, ticker, {r('CASE WHEN sector = ' + chr(39) + 'ASIA' + chr(39) + ' THEN m ELSE coalesce(f, m) END', 'factor')} FROM fx_factor")
add(
    "asof_backward", lambda x: J.asof(x.earnings.select("symbol", "report_date"), x.bars.select(F.col("ticker").alias("symbol"), "date", "close"), ["symbol"], "report_date", "date", "close"),
    f"SELECT symbol, report_date, {r('close', 'close')} FROM fx_earnings e ASOF LEFT JOIN fx_bars b ON b.ticker = e.symbol AND e.report_date >= b.date",
)
add(
    "asof_forward", lambda x: J.asof(x.earnings.select("symbol", "report_date"), x.bars.select(F.col("ticker").alias("symbol"), "date", "close"), ["symbol"], "report_date", "date", "close", "forward"),
    f"SELECT symbol, report_date, {r('close', 'close')} FROM fx_earnings e ASOF LEFT JOIN fx_bars b ON b.ticker = e.symbol AND e.report_date <= b.date",
)
add(
    "asof_strict", lambda x: J.asof(x.bars.select(F.col("ticker").alias("symbol"), "date"), x.bars.select(F.col("ticker").alias("symbol"), F.col("date").alias("d"), "close"), ["symbol"], "date", "d", "close", strict=True),
    f"SELECT a.ticker AS symbol, a.date, {r('b.close', 'close')} FROM fx_bars a ASOF LEFT JOIN fx_bars b ON b.ticker = a.ticker AND a.date > b.date",
)
add(
    "asof_with_expiry", lambda x: J.asof(x.panel.select(F.col("ticker").alias("symbol"), "date"), x.earnings.select("symbol", F.add_months("period", 6).alias("avail"), F.struct("actual", F.add_months("period", 6).alias("avail")).alias("v")), ["symbol"], "date", "avail", "v").select("symbol", "date", F.when(F.datediff("date", F.col("v.avail")) <= 60, F.col("v.actual")).alias("actual")),
    f"SELECT p.ticker AS symbol, p.date, {r('CASE WHEN p.date - e.avail <= 60 THEN e.actual END', 'actual')} FROM fx_panel p ASOF LEFT JOIN (SELECT symbol, CAST(period + INTERVAL 6 MONTH AS DATE) AS avail, actual FROM fx_earnings) e ON e.symbol = p.ticker AND p.date >= e.avail",
)
add("interval_join", lambda x: x.calendar.select("date").join(U.intervals(x.changes), (F.col("date") >= F.col("start")) & (F.col("stop").isNull() | (F.col("date") < F.col("stop")))).select("date", "start", F.size("members").alias("n")), "SELECT date, start, CAST(len(members) AS INTEGER) AS n FROM fx_days JOIN fx_spans ON date >= start AND (stop IS NULL OR date < stop)")
add(
    "band_join_positions", lambda x: J.band(x.earnings.join(x.calendar.select(F.col("date").alias("d"), "pos"), F.col("d") >= F.col("report_date")).groupBy(F.col("symbol").alias("ticker"), "period").agg(F.min("pos").alias("at")), x.panel.join(x.calendar.select("date", "pos"), "date").select("ticker", "pos", "close"), "ticker", -1, 2).select("ticker", "period", "k", "close"),
    f"WITH e AS (SELECT symbol AS ticker, period, (SELECT min(pos) FROM fx_calendar c WHERE c.date >= report_date) AS loc FROM fx_earnings), b AS (SELECT p.ticker, c.pos, p.close FROM fx_panel p JOIN fx_calendar c USING (date)), g AS (SELECT e.*, CAST(unnest([-1, 0, 1, 2]) AS INTEGER) AS k FROM e WHERE loc IS NOT NULL) SELECT g.ticker, period, k, {r('close', 'close')} FROM g LEFT JOIN b ON b.ticker = g.ticker AND b.pos = g.loc + g.k",
)
add("self_join_pairs", lambda x: J.pairs(x.returns.where("ret is not null"), "ticker", "sector", "date", value="ret"), f"SELECT x.date, x.ticker AS a, {r('x.ret', 'va')}, y.ticker AS b, {r('y.ret', 'vb')} FROM fx_returns x JOIN fx_returns y ON x.date = y.date AND x.sector = y.sector AND x.ticker < y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL")
add("semi_isin", lambda x: x.bars.join(x.sectors.where("sector = 'EUROPE'"), "ticker", "left_semi").select(*DT), "SELECT date, ticker FROM fx_bars WHERE ticker IN (SELECT ticker FROM fx_sectors WHERE sector = 'EUROPE')")
add("anti_missing", lambda x: x.panel.where("member").join(x.bars, list(DT), "left_anti").select(*DT), "SELECT date, ticker FROM fx_panel WHERE member AND close IS NULL")
_POS = "SELECT ticker, CAST(sum(CASE WHEN side = 'buy' THEN filled_qty ELSE -filled_qty END) AS DOUBLE) AS qty FROM fx_fills WHERE session {} DATE '2000-01-01' GROUP BY ticker"
_SIGNED = lambda: F.when(F.col("side") == "buy", F.col("filled_qty")).otherwise(-F.col("filled_qty"))
add(
    "full_outer_delta", lambda x: J.delta(x.fills.where("session >= date'2000-01-01'").groupBy("ticker").agg(F.sum(_SIGNED()).alias("qty")), x.fills.where("session < date'2000-01-01'").groupBy("ticker").agg(F.sum(_SIGNED()).alias("qty"))),
    f"WITH t AS ({_POS.format('>=')}), h AS ({_POS.format('<')}), b AS (SELECT ticker, coalesce(t.qty, 0) AS target, coalesce(h.qty, 0) AS held FROM t FULL JOIN h USING (ticker)) SELECT ticker, target, held, target - held AS delta FROM b WHERE target <> held",
)
add(
    "nested_loop_gap", lambda x: J.gaps(x.bars, x.panel.select(*DT, F.when(F.col("ticker") == "N05", F.col("close") + 0.1).otherwise(F.col("close")).alias("close")), list(DT), "close", 1e-6),
    f"SELECT p.date, p.ticker, {r('close', 'x')}, {r('CASE WHEN p.ticker = ' + chr(39) + 'N05' + chr(39) + ' THEN close + 0.1 ELSE close END', 'y')} FROM fx_panel p WHERE p.ticker = 'N05' AND close IS NOT NULL",
)

# rolling windows and time-series signals
_OK = "ret IS NOT NULL AND f IS NOT NULL"
_BETA = f"""b0 AS (SELECT *, CASE WHEN {_OK} THEN f END AS x, CASE WHEN {_OK} THEN ret END AS y FROM fx_factor), b1 AS (SELECT *, {mean('x', 13)} AS mx, {mean('y', 13)} AS my, {mean('x * y', 13)} AS mxy, {mean('x * x', 13)} AS mxx FROM b0),
    b2 AS (SELECT *, CASE WHEN mxx - mx * mx > 1e-18 THEN (mxy - mx * my) / (mxx - mx * mx) END AS beta FROM b1), b3 AS (SELECT *, my - beta * mx AS alpha FROM b2),
    b4 AS (SELECT *, ret - {lag('alpha')} - {lag('beta')} * f AS resid, ret - {lag('beta')} * f AS hedged FROM b3)"""
_S = f"""{_BETA}, s1 AS (SELECT *, CASE WHEN resid IS NOT NULL THEN sum(resid) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) END AS level FROM b4), s2 AS (SELECT *, (level - ({mean('level', 13)})) / nullif({std('level', 13)}, 0) AS s FROM s1)"""
_res = lambda x: W.residual(x.factor, 13)
_s = lambda x: W.s_score(_res(x), 13)
add("rolling_beta", lambda x: W.rolling_beta(x.factor, 13).select(*DT, "beta"), f"WITH {_BETA} SELECT date, ticker, {r('beta', 'beta')} FROM b3")
add("rolling_alpha", lambda x: W.rolling_beta(x.factor, 13).select(*DT, "alpha"), f"WITH {_BETA} SELECT date, ticker, {r('alpha', 'alpha')} FROM b3")
add("rolling_residual", lambda x: _res(x).select(*DT, "resid"), f"WITH {_BETA} SELECT date, ticker, {r('resid', 'resid')} FROM b4")
add("hedged_returns", lambda x: _res(x).select(*DT, "hedged"), f"WITH {_BETA} SELECT date, ticker, {r('hedged', 'hedged')} FROM b4")
add("full_sample_residual", lambda x: W.full_sample_residual(x.factor).select(*DT, "resid"), f"SELECT a.date, a.ticker, {r('ret - my - b * (f - mx)', 'resid')} FROM fx_factor a JOIN (SELECT ticker, avg(f) AS mx, avg(ret) AS my, (avg(f * ret) - avg(f) * avg(ret)) / nullif(avg(f * f) - avg(f) * avg(f), 0) AS b FROM fx_factor WHERE {_OK} GROUP BY ticker) USING (ticker)")
add("s_score", lambda x: _s(x).select(*DT, "level", "s"), f"WITH {_S} SELECT date, ticker, {r('level', 'level')}, {r('s', 's')} FROM s2")
_DRIFT = f"""{_S}, d0 AS (SELECT *, {lag('level')} AS p FROM s2), d1 AS (SELECT *, CASE WHEN p IS NOT NULL AND level IS NOT NULL THEN p END AS x1, CASE WHEN p IS NOT NULL AND level IS NOT NULL THEN level END AS y1 FROM d0),
    d2 AS (SELECT *, {mean('x1', 13)} AS ax, {mean('y1', 13)} AS ay, {mean('x1 * y1', 13)} AS axy, {mean('x1 * x1', 13)} AS axx, {mean('resid', 13)} AS dr, {std('level', 13)} AS sd FROM d1), d3 AS (SELECT *, (axy - ax * ay) / nullif(axx - ax * ax, 0) AS b FROM d2)"""
add("drift_adjusted_s_score", lambda x: W.drift_s_score(_s(x), 13).select(*DT, "s_drift"), f"WITH {_DRIFT} SELECT date, ticker, {r('s - dr / nullif(CASE WHEN b > 0 AND b < 1 THEN -ln(b) END * sd, 0)', 's_drift')} FROM d3")
_NORM = f"n0 AS (SELECT date, ticker, sector, close / {_FIRST} AS norm FROM fx_returns)"
_SPREAD = f"{_NORM}, sp AS (SELECT x.date, x.ticker AS a, y.ticker AS b, x.norm - y.norm AS spread FROM n0 x JOIN n0 y ON x.date = y.date AND x.sector = y.sector AND x.ticker < y.ticker WHERE x.norm IS NOT NULL AND y.norm IS NOT NULL)"
_spread = lambda x: J.pairs(B.normalize(x.returns).where("norm is not null"), "ticker", "sector", "date", value="norm").select("date", "a", "b", (F.col("va") - F.col("vb")).alias("spread"))
add("spread_zscore", lambda x: W.spread_z(_spread(x), 13).select("date", "a", "b", "z"), f"WITH {_SPREAD} SELECT date, a, b, {r('(spread - (' + mean('spread', 13, 'a, b') + ')) / nullif(' + std('spread', 13, 'a, b') + ', 0)', 'z')} FROM sp")
add("pair_zscore_oos", lambda x: W.pair_z_oos(_spread(x), "1999-12-31"), f"WITH {_SPREAD}, fit AS (SELECT a, b, avg(spread) AS mu, stddev_samp(spread) AS sd FROM sp WHERE date <= DATE '1999-12-31' GROUP BY a, b) SELECT a, b, date, {r('(spread - mu) / nullif(sd, 0)', 'z')} FROM sp JOIN fit USING (a, b) WHERE date > DATE '1999-12-31'")
add("realized_vol", lambda x: W.realized_vol(x.returns, 8, 52).select(*DT, "vol"), f"SELECT date, ticker, {r('(' + std('ret', 8) + ') * sqrt(52.0)', 'vol')} FROM fx_returns")
add(
    "ewma_vol", lambda x: W.ewma_vol(x.returns, 10.0),
    f"""WITH o AS (SELECT date, ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM fx_returns WHERE ret IS NOT NULL), k AS (SELECT a.date, a.ticker, a.i, sum(pow(10.0 / 11, a.i - b.i)) AS w, sum(pow(10.0 / 11, 2 * (a.i - b.i))) AS w2, sum(pow(10.0 / 11, a.i - b.i) * b.ret) AS sx, sum(pow(10.0 / 11, a.i - b.i) * b.ret * b.ret) AS sxx FROM o a JOIN o b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2, 3)
    SELECT date, ticker, {r('CASE WHEN i > 1 THEN sqrt(greatest(0, (sxx / w - (sx / w) * (sx / w)) * w * w / (w * w - w2))) END', 'ewma_vol')} FROM k""",
)
add("sma_ratio", lambda x: W.sma_ratio(x.panel, 8).select(*DT, "sma", "above"), f"SELECT date, ticker, {r(mean('close', 8), 'sma')}, {r('close / (' + mean('close', 8) + ') - 1', 'above')} FROM fx_panel")
add("momentum_skip", lambda x: W.momentum(x.panel, 13, 1).select(*DT, "mom"), f"SELECT date, ticker, {r(lag('close', 1) + ' / ' + lag('close', 13) + ' - 1', 'mom')} FROM fx_panel")
_CB = f"""c0 AS (SELECT *, CASE WHEN ret IS NOT NULL AND m IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL AND m IS NOT NULL THEN m END AS y FROM fx_factor), c1 AS (SELECT *, {mean('x * y', 13)} - ({mean('x', 13)}) * ({mean('y', 13)}) AS cov, {mean('x * x', 13)} - ({mean('x', 13)}) * ({mean('x', 13)}) AS vx, {mean('y * y', 13)} - ({mean('y', 13)}) * ({mean('y', 13)}) AS vy FROM c0)"""
add("rolling_corr_beta", lambda x: W.rolling_corr_beta(x.factor, 13).select(*DT, "corr", "cov_beta"), f"WITH {_CB} SELECT date, ticker, {r('CASE WHEN vx > 1e-18 AND vy > 1e-18 THEN cov / sqrt(vx * vy) END', 'corr')}, {r('CASE WHEN vy > 1e-18 THEN cov / vy END', 'cov_beta')} FROM c1")
_DD = "dd0 AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM fx_nets), dd1 AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM dd0)"
add("drawdown_curve", lambda x: W.drawdown(x.nets, "net", "book").select("book", "date", "nav", "peak", "dd"), f"WITH {_DD} SELECT book, date, {r('nav', 'nav')}, {r('peak', 'peak')}, {r('nav / peak - 1', 'dd')} FROM dd1")
_YEAR = "y0 AS (SELECT book, date, row_number() OVER (PARTITION BY book ORDER BY date) AS i, exp(sum(ln(1 + net)) OVER k) - 1 AS year, sum(CAST(net = 0 AS INTEGER)) OVER k AS z FROM fx_nets WINDOW k AS (PARTITION BY book ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)), y1 AS (SELECT * FROM y0 WHERE i >= 52 AND (i - 52) % 13 = 0 AND z <= 26)"
add("rolling_12m", lambda x: W.rolling_year(x.nets, 52, 13, "net", "book").select("book", "date", "year"), f"WITH {_YEAR} SELECT book, date, {r('year', 'year')} FROM y1")
add("walk_forward_summary", lambda x: W.rolling_year(x.nets, 52, 13, "net", "book").groupBy("book").agg(F.percentile("year", F.lit(0.5)).alias("median"), F.avg((F.col("year") > 0).cast("double")).alias("positive"), F.min("year").alias("worst"), F.count("*").alias("windows")), f"WITH {_YEAR} SELECT book, {r('median(year)', 'median')}, {r('avg(CAST(year > 0 AS DOUBLE))', 'positive')}, {r('min(year)', 'worst')}, count(*) AS windows FROM y1 GROUP BY book")
_RUNS = "WITH f AS (SELECT ticker, date, close IS NOT NULL AS priced, coalesce((close IS NOT NULL) <> lag(close IS NOT NULL) OVER (PARTITION BY ticker ORDER BY date), true) AS new FROM fx_panel), g AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY ticker ORDER BY date) AS run FROM f)"
add("run_length", lambda x: W.runs(x.panel.withColumn("priced", F.col("close").isNotNull()), "priced", "ticker"), f"{_RUNS} SELECT ticker, any_value(priced) AS priced, min(date) AS start, max(date) AS \"end\", count(*) AS n FROM g GROUP BY ticker, run")
add("forward_return", lambda x: W.forward_return(x.panel, 4).select(*DT, "fwd"), f"SELECT date, ticker, {r('lead(close, 4) OVER (PARTITION BY ticker ORDER BY date) / close - 1', 'fwd')} FROM fx_panel")

# fit-free signals
_SIG = f"""g0 AS (SELECT *, {lag('close', 4)} / {lag('close', 52)} - 1 AS mo, ret - f AS rs, ln(open / {lag('close')}) AS o, ln(close / open) AS d, {std('ret', 13)} AS sd, {roll('max(close)', 'close', 52)} AS mx FROM fx_factor),
    g1 AS (SELECT *, {total('rs', 48)} AS rsum, {std('rs', 13)} AS disp, CASE WHEN o IS NOT NULL THEN CAST(abs(o) > 2 * sd AND sign(o) = sign(d) AS INTEGER) END AS gap FROM g0)"""
_EACH = {
    "sig_reversal_21d": ("reversal", f"-(close / {lag('close', 4)} - 1)"), "sig_sector_rel_mom": ("sector_rel_mom", "mo - avg(mo) OVER (PARTITION BY date, sector)"), "sig_residual_mom": ("residual_mom", lag("rsum", 4)), "sig_ivol_low": ("ivol_low", "-disp"),
    "sig_dispersion_resid": ("dispersion", "disp - median(disp) OVER (PARTITION BY date, sector)"), "sig_volume_shock": ("volume_shock", f"({mean('volume', 4)}) / ({mean('volume', 52)})"), "sig_overnight_share_126d": ("overnight_share", f"({total('o', 13)}) - ({total('d', 13)})"),
    "sig_low_vol": ("low_vol", "-sd"), "sig_52w_high": ("high_52w", "close / mx"),
}
for _name, (_col, _sql) in _EACH.items():
    add(_name, lambda x, c=_col: W.signals(x.factor).select(*DT, c), f"WITH {_SIG} SELECT date, ticker, {r(_sql, _col)} FROM g1")
add("sig_gap_persistence", lambda x: W.signals(x.factor).select(*DT, "gap_persistence"), f"WITH {_SIG} SELECT date, ticker, CAST(sum(gap) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS BIGINT) AS gap_persistence FROM g1")
add("sig_asset_growth", lambda x: x.earnings.select("symbol", "period", (-(F.col("actual") / F.lag("actual", 4).over(by("symbol", order="period")) - 1)).alias("growth")), f"SELECT symbol, period, {r('-(actual / lag(actual, 4) OVER (PARTITION BY symbol ORDER BY period) - 1)', 'growth')} FROM fx_earnings")

# cross-sectional operators
_mom = lambda x: W.momentum(x.returns, 13, 1)
_fwd = lambda x: W.forward_return(_mom(x), 4).select(*DT, F.col("mom").alias("score"), "fwd", "volume")
_BUCKET = "q0 AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY mom, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM fx_mom WHERE mom IS NOT NULL), q1 AS (SELECT *, CAST(coalesce(greatest(ceil(CAST((k - 1) * 5 AS DOUBLE) / nullif(n - 1, 0) - 1e-12), 1) - 1, 0) AS INTEGER) AS bucket FROM q0)"
add("quantile_bucket", lambda x: C.quantile_bucket(_mom(x), 5, "mom").select(*DT, "bucket"), f"WITH {_BUCKET} SELECT date, ticker, bucket FROM q1")
add("quantile_weights", lambda x: C.quantile_weights(_mom(x), 5, "mom"), f"WITH {_BUCKET} SELECT date, ticker, {r('CASE WHEN bucket = 0 THEN -1.0 ELSE 1.0 END / count(*) OVER (PARTITION BY date, bucket)', 'w')} FROM q1 WHERE n >= 5 AND bucket IN (0, 4)")
add(
    "neutralize_score", lambda x: C.neutralize(_mom(x).select(*DT, "sector", F.col("mom").alias("score"), F.ln("volume").alias("size"))),
    f"WITH d AS (SELECT *, mom - avg(mom) OVER (PARTITION BY date, sector) AS y, ln(volume) - avg(ln(volume)) OVER (PARTITION BY date, sector) AS x, count(*) OVER (PARTITION BY date) AS k FROM fx_mom WHERE mom IS NOT NULL AND volume IS NOT NULL) SELECT date, ticker, {r('y - coalesce(sum(x * y) OVER (PARTITION BY date) / nullif(sum(x * x) OVER (PARTITION BY date), 0), 0) * x', 'resid')} FROM d WHERE k >= 10",
)
_FWD = "f0 AS (SELECT date, ticker, mom AS score, lead(close, 4) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd, volume FROM fx_mom), f1 AS (SELECT * FROM f0 WHERE score IS NOT NULL AND fwd IS NOT NULL)"
_RANK = "rank() OVER ({p} ORDER BY {c}) + (count(*) OVER ({q}{c}) - 1) / 2.0"
_RK = lambda c, keys: _RANK.format(c=c, p=f"PARTITION BY {keys}" if keys else "", q=f"PARTITION BY {keys}, " if keys else "PARTITION BY ")
_CORR = "CASE WHEN var_pop(a) > 1e-18 AND var_pop(b) > 1e-18 THEN (avg(a * b) - avg(a) * avg(b)) / sqrt(var_pop(a) * var_pop(b)) END"
_IC = f"{_FWD}, f2 AS (SELECT date, {_RK('score', 'date')} AS a, {_RK('fwd', 'date')} AS b FROM f1), ic AS (SELECT date, count(*) AS n, {_CORR} AS ic FROM f2 GROUP BY date HAVING count(*) >= 20)"
add("rank_ic", lambda x: C.rank_ic(_fwd(x), 20), f"WITH {_IC} SELECT date, n, {r('ic', 'ic')} FROM ic")
_ICS = f"count(*) AS n, {r('avg(ic)', 'mean')}, {r('avg(ic) * sqrt(count(*)) / nullif(stddev_samp(ic), 0)', 't')}, {r('avg(CAST(ic > 0 AS DOUBLE))', 'hit')}"
add("agg_rollup_ic", lambda x: C.ic_summary(C.rank_ic(_fwd(x), 20)), f"WITH {_IC} SELECT CAST(year(date) AS INTEGER) AS year, {_ICS} FROM ic WHERE ic IS NOT NULL GROUP BY ROLLUP (CAST(year(date) AS INTEGER)) HAVING count(*) > 0")
add("rank_ic_pooled", lambda x: C.pooled_ic(_fwd(x).withColumns({c: F.round(c, 9) for c in ("score", "fwd")})), f"WITH {_FWD.replace('f1 AS (SELECT * FROM', 'f1 AS (SELECT date, ticker, round(score, 9) AS score, round(fwd, 9) AS fwd FROM')}, p AS (SELECT {_RK('score', '')} AS a, {_RK('fwd', '')} AS b FROM f1), c AS (SELECT count(*) AS n, {_CORR} AS ic FROM p) SELECT n, {r('ic', 'ic')}, {r('ic * sqrt(n - 2) / sqrt(1 - ic * ic)', 't')} FROM c")
add(
    "tercile_conditional_ic", lambda x: C.tercile_ic(_fwd(x).withColumnRenamed("volume", "by")),
    f"WITH {_FWD}, t AS (SELECT *, quantile_cont(volume, 1.0 / 3) OVER (PARTITION BY date) AS lo, quantile_cont(volume, 2.0 / 3) OVER (PARTITION BY date) AS hi FROM f1 WHERE volume IS NOT NULL), c AS (SELECT *, CASE WHEN volume <= lo THEN 'low' WHEN volume > hi THEN 'high' END AS cell FROM t), d AS (SELECT date, cell, {_RK('score', 'date, cell')} AS a, {_RK('fwd', 'date, cell')} AS b FROM c WHERE cell IS NOT NULL) SELECT date, cell, count(*) AS n, {r(_CORR, 'ic')} FROM d GROUP BY 1, 2",
)
add("cross_sectional_z", lambda x: C.cross_z(_mom(x), "mom").select(*DT, "z"), f"SELECT date, ticker, {r('(mom - avg(mom) OVER (PARTITION BY date)) / nullif(stddev_pop(mom) OVER (PARTITION BY date), 0)', 'z')} FROM fx_mom")
add(
    "topk_inverse_vol", lambda x: C.topk_inverse_vol(W.realized_vol(_mom(x), 8, 52), 5),
    f"WITH v AS (SELECT *, ({std('ret', 8)}) * sqrt(52.0) AS vol FROM fx_mom), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS u FROM v WHERE mom IS NOT NULL AND vol > 0) SELECT date, ticker, {r('1 / vol / sum(1 / vol) OVER (PARTITION BY date)', 'w')} FROM k WHERE u <= 5",
)
add("argmax_pick", lambda x: C.argmax_pick(_mom(x), 0.02, "CASH"), f"SELECT date, CASE WHEN mom > 0.02 THEN ticker ELSE 'CASH' END AS ticker, {r('mom', 'mom')} FROM fx_ranked WHERE u = 1")
_SSD = f"WITH {_NORM}, p AS (SELECT x.ticker AS a, y.ticker AS b, round(avg(pow(x.norm - y.norm, 2)), 9) AS ssd, count(*) AS days FROM n0 x JOIN n0 y ON x.date = y.date AND x.ticker < y.ticker WHERE x.norm IS NOT NULL AND y.norm IS NOT NULL GROUP BY 1, 2)"
add("closest_pairs", lambda x: C.closest_pairs(B.normalize(x.returns), 20), f"{_SSD} SELECT a, b, {r('ssd', 'ssd')}, days FROM p ORDER BY p.ssd, a, b LIMIT 20")
_PC = "SELECT x.ticker AS a0, y.ticker AS b0, x.ret AS a, y.ret AS b FROM fx_returns x JOIN fx_returns y ON x.date = y.date AND x.ticker < y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL"
add("conditional_corr", lambda x: C.pair_corr(x.returns.join(x.market.select("date", F.col("ret").alias("mkt")), "date").where("mkt < 0")), f"SELECT a0 AS a, b0 AS b, count(*) AS n, {r(_CORR, 'corr')} FROM ({_PC} AND x.date IN (SELECT date FROM fx_market WHERE ret < 0)) GROUP BY 1, 2")
add("jaccard_down_months", lambda x: C.jaccard_down(x.returns), f'SELECT a0 AS a, b0 AS b, count(*) FILTER (a < 0 AND b < 0) AS "both", count(*) FILTER (a < 0 OR b < 0) AS "any", {r("CAST(count(*) FILTER (a < 0 AND b < 0) AS DOUBLE) / nullif(count(*) FILTER (a < 0 OR b < 0), 0)", "jaccard")} FROM ({_PC}) GROUP BY 1, 2')
add("hhi_concentration", lambda x: C.concentration(x.returns, "sector", "ticker", "volume"), f"WITH s AS (SELECT sector, ticker, sum(volume) AS v FROM fx_returns GROUP BY 1, 2), h AS (SELECT *, v / sum(v) OVER (PARTITION BY sector) AS share, row_number() OVER (PARTITION BY sector ORDER BY v DESC, ticker) AS k FROM s) SELECT sector, {r('sum(share * share)', 'hhi')}, {r('sum(share) FILTER (k <= 5)', 'top5')}, count(*) AS n FROM h GROUP BY sector")
add("eff_rank", lambda x: C.effective_rank(C.pair_corr(x.returns), 25), f"WITH c AS (SELECT a0, b0, {_CORR} AS corr FROM ({_PC}) GROUP BY 1, 2) SELECT {r('625.0 / (25 + 2 * sum(coalesce(corr * corr, 0)))', 'eff_rank')} FROM c")

# path-dependent positions
_bands = lambda x: P.band_positions(_s(x), 1.25, 0.5)
_BANDS = f"""{_S}, p1 AS (SELECT *, coalesce(abs(s) <= 0.5, false) AS flat FROM s2), p2 AS (SELECT *, sum(CAST(flat AS INTEGER)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg, CASE WHEN flat THEN NULL WHEN s >= 1.25 THEN -1 WHEN s <= -1.25 THEN 1 END AS e FROM p1),
    p3 AS (SELECT *, CASE WHEN flat THEN 0 ELSE coalesce(first_value(e IGNORE NULLS) OVER (PARTITION BY ticker, seg ORDER BY date ROWS UNBOUNDED PRECEDING), 0) END AS position FROM p2)"""
add("band_positions", lambda x: _bands(x).select(*DT, "position"), f"WITH {_BANDS} SELECT date, ticker, CAST(position AS INTEGER) AS position FROM p3")
_FOLD = "RECURSIVE {base}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM {src}), z AS (SELECT o.ticker, o.date, o.i, {first} AS st FROM o WHERE i = 1 UNION ALL SELECT o.ticker, o.date, o.i, {step} FROM z JOIN o ON o.ticker = z.ticker AND o.i = z.i + 1)"


def _recursive(base: str, src: str, first: str, step: str, out: str) -> str:
    """A fold as a recursive query."""
    return "WITH " + _FOLD.format(base=base, src=src, first=first, step=step).removeprefix("RECURSIVE ") + out


_STEP = "CASE WHEN o.s IS NULL THEN {z} WHEN {z} = 0 THEN CASE WHEN o.s >= 1.25 THEN -1 WHEN o.s <= -1.25 AND o.s > -2 THEN 1 ELSE 0 END WHEN abs(o.s) <= 0.5 OR ({z} = 1 AND o.s <= -2) THEN 0 ELSE {z} END"
add_fold("band_positions_floor", lambda x: P.band_positions_floor(_s(x), 1.25, 0.5, -2.0), _recursive(_S, "s2", _STEP.format(z="0"), _STEP.format(z="z.st"), " SELECT date, ticker, CAST(st AS INTEGER) AS position FROM z"))
_GATE = f"h0 AS (SELECT *, close / ({mean('close', 8)}) - 1 AS above FROM fx_panel)"
add("hysteresis_gate", lambda x: P.hysteresis(W.sma_ratio(x.panel, 8), F.col("above") > 0.01, F.col("above") < -0.01).select(*DT, "gate"), f"WITH {_GATE} SELECT date, ticker, CAST(last_value(CASE WHEN above > 0.01 THEN 1 WHEN above < -0.01 THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS INTEGER) AS gate FROM h0")
_TGT = "tg AS (SELECT date, ticker, mom AS target FROM fx_mom)"
_target = lambda x: _mom(x).select(*DT, F.col("mom").alias("target"))
_BAND = "CASE WHEN o.target IS NOT NULL AND abs(o.target - {z}) > 0.01 THEN o.target ELSE {z} END"
add_fold("tolerance_band", lambda x: P.tolerance_band(_target(x), 0.01), _recursive(_TGT, "tg", _BAND.format(z="CAST(0 AS DOUBLE)"), _BAND.format(z="z.st"), f" SELECT date, ticker, {r('st', 'held')} FROM z"))
_PART = "coalesce({z} + 0.3 * (o.target - {z}), {z})"
add_fold("partial_fill", lambda x: P.partial_fill(_target(x), 0.3), _recursive(_TGT, "tg", _PART.format(z="CAST(0 AS DOUBLE)"), _PART.format(z="z.st"), f" SELECT date, ticker, {r('st', 'held')} FROM z"))
_VOL = f"vo AS (SELECT date, ticker, ({std('ret', 8)}) AS v FROM fx_returns)"
_WAIT = "CASE WHEN o.v >= 0.012 THEN 3.0 WHEN {z} > 0 AND o.v < 0.01 THEN {z} - 1 WHEN {z} > 0 AND o.v IS NOT NULL THEN 3.0 ELSE {z} END"
add_fold("vix_halving_gate", lambda x: P.halving_gate(W.realized_vol(x.returns, 8, 1).select(*DT, F.col("vol").alias("v")), 0.012, 0.01, 3).select(*DT, "exposure"), _recursive(_VOL, "vo", _WAIT.format(z="CAST(0 AS DOUBLE)"), _WAIT.format(z="z.st"), " SELECT date, ticker, CASE WHEN st > 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS exposure FROM z"))
_SPIKE = f"k0 AS (SELECT *, v / nullif({roll('median(v)', 'v', 13)}, 0) AS q FROM vo)"
add(
    "spike_release_gate", lambda x: P.hysteresis(W.realized_vol(x.returns, 8, 1).withColumn("q", F.try_divide(F.col("vol"), rolling_median("vol", 13, "ticker"))), F.col("q") >= 1.1, F.col("q") < 1).select(*DT, "gate"),
    f"WITH {_VOL}, {_SPIKE} SELECT date, ticker, CAST(last_value(CASE WHEN q >= 1.1 THEN 1 WHEN q < 1 THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS INTEGER) AS gate FROM k0",
)
add("event_hold", lambda x: P.event_hold(x.returns, F.col("ret") > 0.02, 4).select(*DT, "active"), "SELECT date, ticker, CAST(coalesce(max(CAST(ret > 0.02 AS INTEGER)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS active FROM fx_returns")
add(
    "blackout_entries", lambda x: P.blackout_entries(_bands(x).withColumn("mask", F.month("date").isin(1, 4, 7, 10))).select(*DT, "position"),
    f"WITH {_BANDS}, m1 AS (SELECT *, month(date) IN (1, 4, 7, 10) AS mask, coalesce(position <> lag(position) OVER (PARTITION BY ticker ORDER BY date), true) AS new FROM p3), m2 AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY ticker ORDER BY date) AS run FROM m1) SELECT date, ticker, CAST(CASE WHEN max(CAST(NOT mask AS INTEGER)) OVER (PARTITION BY ticker, run ORDER BY date ROWS UNBOUNDED PRECEDING) = 1 THEN position ELSE 0 END AS INTEGER) AS position FROM m2",
)
_grid = lambda x: x.panel.select(*DT).join(x.weights.where("book = 'bk_rot'").select("date", "ticker", "w"), list(DT), "left").join(x.calendar.select("date", "pos"), "date").withColumn("w", F.coalesce("w", F.lit(0.0)))
_GRID = "gr AS (SELECT p.date, p.ticker, c.pos, coalesce(w.w, 0) AS w FROM fx_panel p JOIN fx_calendar c USING (date) LEFT JOIN (SELECT * FROM fx_weights WHERE book = 'bk_rot') w ON w.date = p.date AND w.ticker = p.ticker)"
_TR = " + ".join(f"coalesce(last_value(CASE WHEN pos % 4 = {k} THEN w END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0)" for k in range(4))
add("tranche_blend", lambda x: P.tranches(_grid(x), 4).select(*DT, "w"), f"WITH {_GRID} SELECT date, ticker, {r('(' + _TR + ') / 4', 'w')} FROM gr")
add("missed_trades", lambda x: P.missed_trades(_grid(x), 10).select(*DT, "w"), f"WITH {_GRID} SELECT date, ticker, {r('last_value(CASE WHEN (pos * 48271) % 2147483647 % 10 <> 0 THEN w END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)', 'w')} FROM gr")
_HALT = "WITH h AS (SELECT *, count(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg FROM fx_panel), k AS (SELECT *, count(*) FILTER (close IS NULL) OVER (PARTITION BY ticker, seg ORDER BY date ROWS UNBOUNDED PRECEDING) AS days FROM h)"
add("halt_classifier", lambda x: P.halt_counter(x.panel, 2).select(*DT, "days", "state"), f"{_HALT} SELECT date, ticker, days, CASE WHEN days = 0 THEN 'tradable' WHEN days < 2 THEN 'halted' ELSE 'quarantined' END AS state FROM k")
_TRADES = f"{_BANDS}, t1 AS (SELECT p3.*, coalesce(position <> lag(position) OVER (PARTITION BY ticker ORDER BY date), true) AS new, lead(ret) OVER (PARTITION BY ticker ORDER BY date) * position AS pnl FROM p3), t2 AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY ticker ORDER BY date) AS run FROM t1), t3 AS (SELECT ticker, CAST(any_value(position) AS INTEGER) AS side, min(date) AS start, max(date) AS \"end\", count(*) AS n, sum(coalesce(pnl, 0)) AS pnl FROM t2 WHERE position <> 0 GROUP BY ticker, run)"
add("trades_from_positions", lambda x: P.trades(_bands(x)), f"WITH {_TRADES} SELECT ticker, side, start, \"end\", n, {r('pnl', 'pnl')} FROM t3")
add("trade_stats", lambda x: P.trade_stats(P.trades(_bands(x))), f"WITH {_TRADES} SELECT side, count(*) AS trades, {r('avg(CAST(pnl > 0 AS DOUBLE))', 'win_rate')}, {r('avg(n)', 'mean_hold')}, {r('sum(pnl)', 'pnl')} FROM t3 GROUP BY side")

# exposure and P&L
_TW = f"{_BANDS}, w1 AS (SELECT *, coalesce(CAST(position AS DOUBLE) / nullif(sum(abs(position)) OVER (PARTITION BY date), 0), 0) AS w FROM p3)"
add("to_weights", lambda x: L.to_weights(_bands(x)).select(*DT, "w"), f"WITH {_TW} SELECT date, ticker, {r('w', 'w')} FROM w1")
_CAP = f"{_TW}, w2 AS (SELECT *, greatest(-0.08, least(0.08, w)) AS c FROM w1), w3 AS (SELECT *, abs(sum(c) OVER (PARTITION BY date, sector)) AS sn FROM w2), w4 AS (SELECT *, CASE WHEN sn > 0.1 THEN c * 0.1 / sn ELSE c END AS capped FROM w3)"
add("sector_name_cap", lambda x: L.name_sector_cap(L.to_weights(_bands(x)), 0.08, 0.1).select(*DT, "w"), f"WITH {_CAP} SELECT date, ticker, {r('coalesce(capped / nullif(sum(abs(capped)) OVER (PARTITION BY date), 0), 0)', 'w')} FROM w4")
add("gross_cap", lambda x: L.gross_cap(x.weights, 1.5), f"SELECT book, date, ticker, {r('CASE WHEN g > 1.5 THEN w * 1.5 / g ELSE w END', 'w')}, g > 1.5 AS capped FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY book, date) AS g FROM fx_weights)")
_VT = "(CASE WHEN count(net) OVER k = 13 THEN stddev_samp(net) OVER k END) * sqrt(52.0)"
add("vol_target_overlay", lambda x: L.vol_target(x.nets, 0.02, 13, 52, 0.5, 2.0).select("book", "date", "lev"), f"WITH v AS (SELECT *, {_VT} AS vol FROM fx_nets WINDOW k AS (PARTITION BY book ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)), u AS (SELECT *, 0.02 / nullif(lag(vol) OVER (PARTITION BY book ORDER BY date), 0) AS q FROM v) SELECT book, date, {r('coalesce(CASE WHEN q IS NOT NULL THEN least(greatest(q, 0.5), 2.0) END, 1)', 'lev')} FROM u")
add("backtest", lambda x: x.nets, f"SELECT book, date, {r('gross', 'gross')}, {r('cost', 'cost')}, {r('net', 'net')}, {r('turnover', 'turnover')} FROM fx_nets")
add("cost_scenarios", lambda x: L.cost_scenarios(x.nets, [0.0, 5.0, 10.0, 20.0], 10.0), f"SELECT book, bps, {r('sum(gross - cost * bps / 10)', 'total')}, {r('avg(gross - cost * bps / 10)', 'mean_net')} FROM fx_nets CROSS JOIN (SELECT CAST(unnest([0, 5, 10, 20]) AS DOUBLE) AS bps) GROUP BY 1, 2")
_EW = f"{_BANDS}, e1 AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY date), 0) AS h FROM p3), e2 AS (SELECT *, coalesce(abs(h - lag(h) OVER (PARTITION BY ticker ORDER BY date)), 0) AS d FROM e1), e3 AS (SELECT date, CAST(sum(abs(h)) AS BIGINT) AS n, coalesce((coalesce(sum(h * ret), 0) - sum(d) * 0.002) / nullif(sum(abs(h)), 0), 0) AS net FROM e2 GROUP BY date), e4 AS (SELECT *, sum(CAST(net <> 0 AS INTEGER)) OVER (ORDER BY date) AS live FROM e3)"
add("equal_weight_net", lambda x: L.equal_weight_net(_bands(x), 10.0), f"WITH {_EW} SELECT date, n, {r('net', 'net')} FROM e4 WHERE live > 0")
add("timing_decomp", lambda x: L.timing_split(x.weights, x.returns.select(*DT, "ret"), x.calendar.select("date")), f"WITH t AS (SELECT h.*, avg(held) OVER (PARTITION BY book, ticker) AS m, ret FROM fx_held h LEFT JOIN (SELECT date, ticker, ret FROM fx_returns) USING (date, ticker)), d AS (SELECT book, date, coalesce(sum(m * ret), 0) AS s, coalesce(sum((held - m) * ret), 0) AS t FROM t GROUP BY 1, 2) SELECT book, {r('avg(s)', 'static')}, {r('avg(t)', 'timing')} FROM d GROUP BY book")
add("exposure_overlap", lambda x: L.exposure(x.weights), f"SELECT book, ticker, {r('avg(abs(w))', 'mean_abs')}, count(*) AS days FROM fx_weights GROUP BY 1, 2")
add("compare_books", lambda x: L.compare_books(x.nets, "bk_ew", "bk_rot", 0.001), f"SELECT min(date) FILTER (g > 0.001) AS first, count(*) FILTER (g > 0.001) AS days, {r('max(g)', 'largest')} FROM (SELECT date, abs(coalesce(x.net, 0) - coalesce(y.net, 0)) AS g FROM (SELECT * FROM fx_nets WHERE book = 'bk_ew') x FULL JOIN (SELECT * FROM fx_nets WHERE book = 'bk_rot') y USING (date))")

# metrics and inference
_SR = lambda c: f"CASE WHEN count({c}) < 2 OR coalesce(stddev_samp({c}), 0) <= 1e-18 THEN 0.0 ELSE avg({c}) / stddev_samp({c}) * sqrt(52.0) END"
add(
    "scorecard", lambda x: M.scorecard(x.nets, 52),
    f"WITH {_DD}, i AS (SELECT *, nav / peak - 1 AS dd, row_number() OVER (PARTITION BY book ORDER BY date) <= floor(count(*) OVER (PARTITION BY book) / 2) AS h FROM dd1), j AS (SELECT *, CASE WHEN h THEN net END AS n1, CASE WHEN NOT h THEN net END AS n2 FROM i) SELECT book, count(net) AS n, {r(_SR('net'), 'sharpe')}, {r('avg(CAST(net > 0 AS DOUBLE))', 'hit')}, {r('min(dd)', 'max_dd')}, {r('exp(sum(ln(1 + net)) * 52 / count(net)) - 1', 'cagr')}, {r('stddev_samp(net) * sqrt(52.0)', 'vol')}, {r('avg(turnover)', 'turnover')}, {r('sum(cost)', 'cost')}, {r(_SR('n1'), 'sharpe_1')}, {r(_SR('n2'), 'sharpe_2')} FROM j GROUP BY book",
)
add("sharpe", lambda x: x.nets.groupBy("book").agg(M.sharpe("net", 52).alias("sharpe")), f"SELECT book, {r(_SR('net'), 'sharpe')} FROM fx_nets GROUP BY book")
add("max_drawdown", lambda x: W.drawdown(x.nets, "net", "book").groupBy("book").agg(F.min("dd").alias("max_dd"), F.min_by("date", F.struct(F.round("dd", 9), "date")).alias("trough")), f"WITH {_DD} SELECT book, {r('min(nav / peak - 1)', 'max_dd')}, first(date ORDER BY round(nav / peak - 1, 9), date) AS trough FROM dd1 GROUP BY book")
add("hit_rate", lambda x: x.nets.groupBy("book").agg(F.avg((F.col("net") > 0).cast("double")).alias("hit")), f"SELECT book, {r('avg(CAST(net > 0 AS DOUBLE))', 'hit')} FROM fx_nets GROUP BY book")
_MOM = "mo AS (SELECT book, count(net) AS n, avg(net) AS mean, stddev_samp(net) AS sd, var_pop(net) AS m2, avg(net * net) AS p2, avg(net * net * net) AS p3, avg(net * net * net * net) AS p4 FROM fx_nets GROUP BY book), ms AS (SELECT *, (p3 - 3 * mean * p2 + 2 * pow(mean, 3)) / pow(m2, 1.5) AS skew, (p4 - 4 * mean * p3 + 6 * mean * mean * p2 - 3 * pow(mean, 4)) / (m2 * m2) AS kurt, mean / sd AS sr FROM mo)"
add("moments", lambda x: M.moments(x.nets), f"WITH {_MOM} SELECT book, n, {r('mean', 'mean')}, {r('sd', 'sd')}, {r('skew', 'skew')}, {r('kurt', 'kurt')} FROM ms")
add("deflated_sharpe", lambda x: M.deflated_z(x.nets, 0.05), f"WITH {_MOM} SELECT book, n, {r('sr', 'sr')}, {r('skew', 'skew')}, {r('kurt', 'kurt')}, {r('(sr - 0.05) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)', 'z')} FROM ms")
_LAGS = lambda n: ", ".join(f"d * lag(d, {k}) OVER (PARTITION BY book ORDER BY date) AS c{k}" for k in range(1, n + 1))
_AC = lambda n: f"a0 AS (SELECT book, date, net, net - avg(net) OVER (PARTITION BY book) AS d FROM fx_nets), a1 AS (SELECT *, {_LAGS(n)} FROM a0)"
add("dsr_autocorr_adjusted", lambda x: M.autocorr_inflation(x.nets, 3), f"WITH {_AC(3)} SELECT book, count(*) AS n, {r(' + '.join(['1.0', *(f'2 * (1 - {k}.0 / count(*)) * sum(c{k}) / nullif(sum(d * d), 0)' for k in (1, 2, 3))]), 'inflation')} FROM a1 GROUP BY book")
add("nw_mean", lambda x: M.nw_mean(x.nets, 4), f"WITH {_AC(4)} SELECT book, count(*) AS n, {r('avg(net)', 'mean')}, {r('avg(net) * count(*) / nullif(sqrt(greatest(sum(d * d) + ' + ' + '.join(f'2 * (1 - {k} / 5.0) * sum(c{k})' for k in (1, 2, 3, 4)) + ', 0)), 0)', 't')} FROM a1 GROUP BY book")
_LEVEL = lambda: F.when(F.col("ret") < -0.002, "down").when(F.col("ret") > 0.002, "up").otherwise("flat")
add("regime_table", lambda x: M.regime_table(x.nets, x.market.where("ret is not null").select("date", _LEVEL().alias("regime"))), f"WITH g AS (SELECT date, lag(CASE WHEN ret < -0.002 THEN 'down' WHEN ret > 0.002 THEN 'up' ELSE 'flat' END) OVER (ORDER BY date) AS regime FROM fx_market WHERE ret IS NOT NULL) SELECT book, regime, count(*) AS days, {r('sum(ln(1 + net))', 'log_net')}, {r(_SR('net'), 'sharpe')} FROM fx_nets JOIN g USING (date) WHERE regime IS NOT NULL GROUP BY 1, 2")
add("stress_episodes", lambda x: M.episodes(x.market.where("ret is not null").select("date", F.abs("ret").alias("v")), 0.004, 6), f"WITH a AS (SELECT date, abs(ret) AS v, row_number() OVER (ORDER BY date) AS i FROM fx_market WHERE ret IS NOT NULL), b AS (SELECT *, coalesce(i - lag(i) OVER (ORDER BY date) >= 6, true) AS new FROM a WHERE v >= 0.004), c AS (SELECT *, CAST(sum(CAST(new AS INTEGER)) OVER (ORDER BY date) AS BIGINT) AS episode FROM b) SELECT episode, min(date) AS start, max(date) AS \"end\", count(*) AS n, {r('max(v)', 'peak')} FROM c GROUP BY episode")
add("crash_windows", lambda x: M.crash_windows(x.nets, [("spring", "1996-02-28", "1996-05-31"), ("late", "2000-01-01", "2001-12-31")]), f"SELECT book, name, {r('exp(sum(ln(1 + net))) - 1', 'ret')}, count(*) AS n FROM fx_nets JOIN (VALUES ('spring', DATE '1996-02-28', DATE '1996-05-31'), ('late', DATE '2000-01-01', DATE '2001-12-31')) w(name, s, e) ON date > s AND date <= e GROUP BY 1, 2")
add("paired_t", lambda x: M.paired_t(x.nets, "bk_mom", "bk_ew"), f"WITH p AS (SELECT a.net - b.net AS d FROM fx_nets a JOIN fx_nets b USING (date) WHERE a.book = 'bk_mom' AND b.book = 'bk_ew') SELECT count(d) AS n, {r('avg(d)', 'mean')}, {r('avg(d) * sqrt(count(d)) / nullif(stddev_samp(d), 0)', 't')}, {r('avg(CAST(d > 0 AS DOUBLE))', 'share')} FROM p")
add(
    "block_bootstrap_sharpe", lambda x: M.block_bootstrap_sharpe(x.nets, 100, 20, 52),
    f"""WITH s AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS pos, net FROM fx_nets), z AS (SELECT book, count(*) AS n FROM s GROUP BY book), g AS (SELECT book, n, sim, b, ((sim * 1009 + b * 9176 + 12345) * 48271) % 2147483647 AS h FROM z, range(100) q(sim), range(200) u(b) WHERE b < ceil(n / 20)),
    k AS (SELECT book, n, sim, b, ((h * h + 31 * h) % 2147483647 * 69621) % 2147483647 % n AS st FROM g), i AS (SELECT k.book, sim, (st + j) % n AS pos FROM k, range(20) v(j) WHERE b * 20 + j < n), e AS (SELECT book, sim, {_SR('net')} AS sr FROM i JOIN s USING (book, pos) GROUP BY 1, 2) SELECT book, {r('quantile_cont(sr, 0.05)', 'p05')}, {r('quantile_cont(sr, 0.5)', 'p50')}, {r('quantile_cont(sr, 0.95)', 'p95')} FROM e GROUP BY book""",
)
_cov = lambda a, b: f"(avg({a} * {b}) - avg({a}) * avg({b}))"
_FF = "ff AS (SELECT date, avg(ret) AS mkt, avg(ret) FILTER (sector = 'ASIA') - avg(ret) FILTER (sector = 'EUROPE') AS hml FROM fx_returns GROUP BY date)"
_ff = lambda x: x.nets.join(x.returns.groupBy("date").agg(F.avg("ret").alias("mkt"), (F.avg(F.when(F.col("sector") == "ASIA", F.col("ret"))) - F.avg(F.when(F.col("sector") == "EUROPE", F.col("ret")))).alias("hml")), "date")
add(
    "residualize_books", lambda x: M.ols_two(_ff(x), "mkt", "hml"),
    f"WITH {_FF}, g AS (SELECT book, count(*) AS n, avg(net) AS my, avg(mkt) AS m1, avg(hml) AS m2, var_pop(mkt) AS v1, var_pop(hml) AS v2, {_cov('mkt', 'hml')} AS c12, {_cov('net', 'mkt')} AS c1, {_cov('net', 'hml')} AS c2, var_pop(net) AS vy FROM fx_nets JOIN ff USING (date) WHERE mkt IS NOT NULL AND hml IS NOT NULL GROUP BY book), b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM g) SELECT book, n, {r('my - b1 * m1 - b2 * m2', 'alpha')}, {r('b1', 'b1')}, {r('b2', 'b2')}, {r('(b1 * c1 + b2 * c2) / vy', 'r2')} FROM b",
)
_UD = lambda f: f"({_cov('net', 'mkt').replace('avg(net * mkt)', f'avg(net * mkt) {f}').replace('avg(net) *', f'avg(net) {f} *').replace('avg(mkt))', f'avg(mkt) {f})')}) / nullif(var_pop(mkt) {f}, 0)"
add("up_down_beta", lambda x: M.up_down_beta(_ff(x).withColumnRenamed("mkt", "m")), f"WITH {_FF} SELECT book, {r(_UD(''), 'beta')}, {r(_UD('FILTER (mkt > 0)'), 'up')}, {r(_UD('FILTER (mkt <= 0)'), 'down')} FROM fx_nets JOIN ff USING (date) WHERE mkt IS NOT NULL GROUP BY book")

# event studies
add("surprise_score", lambda x: V.surprise(x.earnings).select("symbol", "period", "surprise"), f"SELECT symbol, period, {r('CASE WHEN estimate IS NOT NULL THEN (actual - estimate) / greatest(abs(estimate), 0.01) END', 'surprise')} FROM fx_earnings")
_SUE = "su0 AS (SELECT *, actual - estimate AS d FROM fx_sessions WHERE estimate IS NOT NULL AND actual IS NOT NULL), su AS (SELECT *, d / nullif(CASE WHEN count(d) OVER k >= 2 THEN stddev_samp(d) OVER k ELSE abs(estimate) END, 0) AS sue FROM su0 WINDOW k AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"
add("sue_trailing", lambda x: V.trailing_sue(x.earnings).select("symbol", "period", "sue"), f"WITH {_SUE} SELECT symbol, period, {r('sue', 'sue')} FROM su")
add("reaction_session", lambda x: V.reaction_session(x.earnings, x.calendar).select("symbol", "period", "session"), "SELECT symbol, period, session FROM fx_sessions")
_CAR = "cp AS (SELECT ticker, date, ret - m AS ar, dense_rank() OVER (ORDER BY date) AS pos FROM fx_factor), ce AS (SELECT symbol AS ticker, period, p.pos + k.k AS pos, CAST(k.k AS INTEGER) AS k FROM fx_sessions s JOIN (SELECT DISTINCT date, pos FROM cp) p ON p.date = s.session CROSS JOIN (SELECT unnest(range(-1, 7)) AS k) k), ca AS (SELECT ce.ticker, period, k, CASE WHEN ce.ticker IN (SELECT ticker FROM cp) THEN sum(coalesce(ar, 0)) OVER (PARTITION BY ce.ticker, period ORDER BY k ROWS UNBOUNDED PRECEDING) END AS car FROM ce LEFT JOIN cp ON cp.ticker = ce.ticker AND cp.pos = ce.pos)"
_cars = lambda x: V.car(V.reaction_session(x.earnings, x.calendar).where("session is not null"), x.factor, -1, 6)
add("car_matrix", _cars, f"WITH {_CAR} SELECT ticker, period, k, {r('car', 'car')} FROM ca")
_EB = "eb0 AS (SELECT symbol, period, sue, row_number() OVER (ORDER BY sue, symbol || '|' || CAST(period AS VARCHAR)) AS k, count(*) OVER () AS n FROM su WHERE sue IS NOT NULL), eb AS (SELECT *, greatest(ceil(CAST((k - 1) * 5 AS DOUBLE) / (n - 1) - 1e-12), 1) - 1 AS bucket FROM eb0)"
add("drift_spread", lambda x: V.drift_spread(_cars(x), V.trailing_sue(x.earnings), 5), f"WITH {_CAR}, {_SUE}, {_EB} SELECT ca.k, {r('avg(car) FILTER (bucket = 4)', 'top')}, {r('avg(car) FILTER (bucket = 0)', 'low')}, {r('avg(car) FILTER (bucket = 4) - avg(car) FILTER (bucket = 0)', 'spread')} FROM ca JOIN eb ON eb.symbol = ca.ticker AND eb.period = ca.period GROUP BY ca.k")
add("ic_decay", lambda x: V.ic_decay(_cars(x), V.trailing_sue(x.earnings), [1, 3, 6]), f"WITH {_CAR}, {_SUE}, j AS (SELECT k, sue AS a, car AS b FROM ca JOIN su ON su.symbol = ca.ticker AND su.period = ca.period WHERE k IN (1, 3, 6) AND sue IS NOT NULL AND car IS NOT NULL) SELECT k, count(*) AS n, {r(_CORR, 'ic')}, {r('avg(CAST(sign(a) = sign(b) AS DOUBLE))', 'hit')} FROM j GROUP BY k")

# point-in-time macro layer
_LAG = {"purchase": 1, "error": 1}
_DOW = "(isodow(obs_date) - 1)"
_AV = f"av AS (SELECT series, value, obs_date, CASE WHEN series IN ('purchase', 'error') THEN 1 ELSE 0 END AS k, obs_date - CAST(greatest({_DOW} - 4, 0) AS INTEGER) AS base FROM fx_series), aw AS (SELECT *, base + CAST(k + 2 * floor((isodow(base) - 1 + k) / 5) AS INTEGER) AS avail_date FROM av)"
add("avail_shift", lambda x: V.available(x.series, _LAG), f"WITH {_AV} SELECT series, CAST(avail_date AS DATE) AS avail_date, {r('arg_max(value, obs_date)', 'value')}, max(obs_date) AS obs_date FROM aw GROUP BY 1, 2")
_wide = lambda x: x.series.groupBy("obs_date").pivot("series", ["click", "error", "purchase", "view"]).agg(F.first("value"))
add("state_features", lambda x: V.state_features(_wide(x), [("click", "view"), ("purchase", "error")]).drop("click", "error", "purchase", "view"), f"WITH w AS (SELECT obs_date, any_value(value) FILTER (series = 'click') AS c, any_value(value) FILTER (series = 'view') AS v, any_value(value) FILTER (series = 'purchase') AS p, any_value(value) FILTER (series = 'error') AS e FROM fx_series GROUP BY obs_date) SELECT obs_date, {r('c - v', 'click_less_view')}, {r('p - e', 'purchase_less_error')}, {r('c / nullif(v, 0)', 'click_over_view')}, {r('p / nullif(e, 0)', 'purchase_over_error')} FROM w")
_vint = lambda x: x.series.select("series", "obs_date", F.date_add("obs_date", 1).alias("realtime_start"), "value").unionByName(x.series.where(F.dayofmonth("obs_date") % 7 == 0).select("series", "obs_date", F.date_add("obs_date", 4).alias("realtime_start"), (F.col("value") * 1.01).alias("value")))
add("revision_provenance", lambda x: V.provenance(_vint(x)), f"SELECT series, obs_date, {r('value', 'first')}, {r('CASE WHEN day(obs_date) % 7 = 0 THEN value * 1.01 ELSE value END', 'latest')}, 1 AS lag_days, CASE WHEN day(obs_date) % 7 = 0 THEN CAST(2 AS BIGINT) ELSE 1 END AS vintages, day(obs_date) % 7 = 0 AND value <> 0 AS revised FROM fx_series")
add("series_manifest", lambda x: V.manifest(x.series, 30), f"SELECT series, min(obs_date) AS first, max(obs_date) AS last, count(value) AS n, {r('1 - count(value) / 30.0', 'missing')} FROM fx_series GROUP BY series")
add("leakage_audit", lambda x: V.truncation_audit(_mom(x), _mom_cut(x), list(DT), "mom"), "SELECT count(*) AS cells, CAST(0 AS BIGINT) AS leaks, 'PASS' AS verdict FROM fx_panel WHERE date < DATE '1999-01-01'")
_mom_cut = lambda x: W.momentum(x.returns.where("date < date'1999-01-01'"), 13, 1)
_LIFE = "lf AS (SELECT *, min(date) FILTER (close IS NOT NULL) OVER (PARTITION BY ticker) AS f0, max(date) FILTER (close IS NOT NULL) OVER (PARTITION BY ticker) AS l0, close = lag(close) OVER (PARTITION BY ticker ORDER BY date) AS same FROM fx_panel)"
add("panel_quality", lambda x: V.panel_quality(x.panel), f"WITH {_LIFE} SELECT ticker, count(*) AS cells, count(*) FILTER (close IS NULL AND date BETWEEN f0 AND l0) AS holes, count(*) FILTER (member AND close IS NULL) AS member_unpriced, count(*) FILTER (same) AS flat, count(*) FILTER (close <= 0) AS nonpositive, any_value(f0) AS first, any_value(l0) AS last FROM lf GROUP BY ticker")

# ledgers and reconciliation
add("exchange_session", lambda x: O.exchange_session(x.fills).groupBy("local_date", "pre_open").agg(F.count("*").alias("n")), "SELECT CAST(submitted_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS local_date, strftime(submitted_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%H:%M') < '09:30' AS pre_open, count(*) AS n FROM fx_fills GROUP BY 1, 2")
_SLIP = "CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END * (price / close - 1) * 10000"
add("slippage_bps", lambda x: O.slippage_summary(x.fills), f"SELECT ticker, side, count(*) AS fills, {r(f'avg({_SLIP})', 'mean_bps')}, {r(f'sum({_SLIP} * filled_qty * price) / nullif(sum(filled_qty * price), 0)', 'weighted_bps')} FROM fx_fills WHERE filled_qty > 0 GROUP BY 1, 2")
_REC = f"rc AS (SELECT session, count(*) AS orders, count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (status = 'partially_filled') AS partial, count(*) FILTER (status = 'rejected') AS rejected, sum(filled_qty) / nullif(sum(qty), 0) AS fill_rate, avg({_SLIP}) FILTER (filled_qty > 0) AS slip_bps FROM fx_fills GROUP BY session), rd AS (SELECT *, concat_ws('|', CASE WHEN fill_rate < 0.6 THEN 'low_fill' END, CASE WHEN rejected > 0 THEN 'rejects' END, CASE WHEN abs(round(slip_bps, 6)) > 15 THEN 'slippage' END) AS signature FROM rc)"
add("reconcile_date", lambda x: O.reconcile(x.fills), f"WITH {_REC} SELECT session, orders, filled, partial, rejected, {r('fill_rate', 'fill_rate')}, {r('slip_bps', 'slip_bps')}, signature FROM rd")
add("condition_signature", lambda x: O.signature_changes(O.reconcile(x.fills)).select("session", "before", "signature"), f"WITH {_REC}, b AS (SELECT session, lag(signature) OVER (ORDER BY session) AS before, signature FROM rd) SELECT * FROM b WHERE before IS NULL OR before <> signature")
add("fill_positions", lambda x: O.positions(x.fills), "SELECT ticker, session, sum(sum(CASE WHEN side = 'buy' THEN filled_qty ELSE -filled_qty END)) OVER (PARTITION BY ticker ORDER BY session) AS qty FROM fx_fills GROUP BY 1, 2")
_RUNQ = "OVER (PARTITION BY ticker ORDER BY session, client_order_id"
_ENT = f"""WITH e0 AS (SELECT ticker, session, client_order_id, price AS p, CAST(CASE WHEN side = 'buy' THEN filled_qty ELSE -filled_qty END AS DOUBLE) AS q FROM fx_fills WHERE filled_qty > 0),
    e1 AS (SELECT *, sum(q) {_RUNQ} ROWS UNBOUNDED PRECEDING) AS after FROM e0), e2 AS (SELECT *, after - q AS before, sum(CAST(after - q = 0 OR (after - q) * after < 0 AS INTEGER)) {_RUNQ} ROWS UNBOUNDED PRECEDING) AS seg FROM e1),
    e3 AS (SELECT *, row_number() OVER (PARTITION BY ticker, seg ORDER BY session, client_order_id) AS i FROM e2 QUALIFY seg = max(seg) OVER (PARTITION BY ticker)),
    e4 AS (SELECT *, CASE WHEN i = 1 THEN p WHEN before * q > 0 THEN p * q / after ELSE 0 END AS share, CASE WHEN i > 1 AND before * q > 0 THEN ln(before / after) ELSE 0 END AS keeps FROM e3),
    e5 AS (SELECT *, coalesce(sum(keeps) {_RUNQ} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM e4), z AS (SELECT ticker, arg_max(after, i) AS qty, sum(share * exp(later)) AS p FROM e5 GROUP BY ticker)"""
add("avg_entry_price", lambda x: O.average_entry(x.fills), f"{_ENT} SELECT ticker, qty, {r('CASE WHEN qty = 0 THEN 0 ELSE p END', 'avg_price')} FROM z")
add("trailing_means", lambda x: O.trailing_slippage(x.fills, 20), f"WITH s AS (SELECT ticker, session, {_SLIP} AS b, row_number() OVER (PARTITION BY ticker ORDER BY session DESC, client_order_id DESC) AS k FROM fx_fills WHERE filled_qty > 0) SELECT ticker, count(*) AS n, {r('avg(b)', 'mean_bps')}, max(session) AS last, max(session) >= (SELECT max(session) FROM fx_fills) - 30 AS fresh FROM s WHERE k <= 20 GROUP BY ticker")
_STREAK = f"WITH d AS (SELECT ticker, session, avg({_SLIP}) AS b FROM fx_fills WHERE filled_qty > 0 GROUP BY 1, 2), e AS (SELECT *, CAST(abs(b) > 13.7 AS INTEGER) AS o FROM d), g AS (SELECT *, sum(1 - o) OVER (PARTITION BY ticker ORDER BY session) AS seg FROM e)"
add("breach_streak", lambda x: O.breach_streak(x.fills, 13.7), f"{_STREAK} SELECT ticker, session, {r('b', 'slip_bps')}, CAST(sum(o) OVER (PARTITION BY ticker, seg ORDER BY session) AS BIGINT) AS streak FROM g")
add("ledger_completeness", lambda x: O.completeness(x.calendar.select(F.col("date").alias("session")), x.fills.where("side = 'buy'"), x.fills.where("status = 'rejected'")), "WITH a AS (SELECT DISTINCT session FROM fx_fills WHERE side = 'buy'), b AS (SELECT DISTINCT session FROM fx_fills WHERE status = 'rejected') SELECT date AS session, CASE CAST(a.session IS NOT NULL AS INTEGER) + CAST(b.session IS NOT NULL AS INTEGER) WHEN 2 THEN 'HEALTHY' WHEN 1 THEN 'PARTIAL' ELSE 'MISSING' END AS state FROM fx_days LEFT JOIN a ON a.session = date LEFT JOIN b ON b.session = date")
add("whole_shares", lambda x: O.whole_shares(x.weights.join(x.bars.select(*DT, F.col("close").alias("price")), list(DT)).withColumn("dollars", F.col("w") * 100000)).select("book", *DT, "shares", (F.col("effective") / 1000).alias("effective_thousands")), f"SELECT book, date, ticker, round_even(w * 100000 / close, 0) AS shares, {r('round_even(w * 100000 / close, 0) * close / 1000', 'effective_thousands')} FROM fx_weights JOIN fx_bars USING (date, ticker)")
def _newest(x):  # noqa: ANN001, ANN202
    """Each book's targets of its newest date."""
    return x.weights.join(x.weights.groupBy("book").agg(F.max("date").alias("date")), ["book", "date"], "left_semi")


_NEW = "nw AS (SELECT w.* FROM fx_weights w JOIN (SELECT book, max(date) AS date FROM fx_weights GROUP BY book) USING (book, date))"
add(
    "foreign_positions", lambda x: O.foreign(O.positions(x.fills).groupBy("ticker").agg(F.max_by("qty", "session").alias("qty")).join(x.bars.groupBy("ticker").agg(F.max_by("close", "date").alias("price")), "ticker"), _newest(x).where("book <> 'bk_ew'")),
    f"WITH {_NEW}, p AS (SELECT ticker, sum(CASE WHEN side = 'buy' THEN filled_qty ELSE -filled_qty END) AS qty FROM fx_fills GROUP BY 1), c AS (SELECT ticker, arg_max(close, date) AS price FROM fx_bars GROUP BY 1) SELECT ticker, qty, {r('qty * price', 'value')}, {r('abs(qty * price)', 'gross')} FROM p JOIN c USING (ticker) WHERE qty <> 0 AND ticker NOT IN (SELECT ticker FROM nw WHERE book <> 'bk_ew')",
)
add(
    "route_targets", lambda x: O.route(_newest(x).select(F.when(F.col("book") == "bk_mom", "margin").otherwise("cash").alias("account"), "ticker", (F.col("w") * 1000).alias("dollars"))),
    f"WITH {_NEW}, g AS (SELECT CASE WHEN book = 'bk_mom' THEN 'margin' ELSE 'cash' END AS account, ticker, sum(w * 1000) AS dollars FROM nw GROUP BY 1, 2) SELECT account, ticker, {r('dollars', 'dollars')}, count(*) OVER (PARTITION BY ticker) > 1 AS shared FROM g",
)
add("last_live_rows", lambda x: O.last_by_key(x.fills.select("ticker", "session", "client_order_id", "status"), ["ticker", "session"], "client_order_id"), "SELECT ticker, session, max(client_order_id) AS client_order_id, arg_max(status, client_order_id) AS status FROM fx_fills GROUP BY 1, 2")
_RUN = lambda x: x.calendar.where("month_first").select(F.col("date").cast("timestamp_ntz").alias("run_at"), F.col("date").alias("run")).crossJoin(x.sectors.select("ticker"))  # noqa: E731  runs for each ticker, so that orders spread by ticker
add("bucket_orders", lambda x: J.asof(x.fills.select("ticker", "client_order_id", "submitted_at"), _RUN(x), ["ticker"], "submitted_at", "run_at", "run").groupBy("run").agg(F.count("*").alias("n")), "SELECT run, count(*) AS n FROM fx_fills f ASOF LEFT JOIN (SELECT CAST(date AS TIMESTAMP) AS run_at, date AS run FROM fx_calendar WHERE month_first) r ON f.submitted_at >= r.run_at GROUP BY run")

# streams: each settles to its batch twin
from panelweave.streaming import jobs as T  # noqa: E402

_events = lambda x: T.source(x.spark, x.dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
add("st_dedupe_events", lambda x: T.settle(T.first_arrivals(_events(x), "user_id", "event_type")), "SELECT DISTINCT user_id, event_type FROM events")
_TUM = "SELECT event_type, date_trunc('day', ts) AS start, first(value ORDER BY ts, event_id) AS o, last(value ORDER BY ts, event_id) AS c, min(value) AS l, max(value) AS h, sum(CAST(round(value * 10000) AS BIGINT)) AS v, count(*) AS n FROM events GROUP BY 1, 2"
add("st_bars_tumbling", lambda x: T.settle(T.tumbling(_events(x), "event_type", "value", "1 day"), "update", ["event_type", "start"]).withColumn("start", F.to_date("start")), f"SELECT event_type, CAST(start AS DATE) AS start, {r('o', 'open')}, {r('c', 'close')}, {r('l', 'low')}, {r('h', 'high')}, CAST(v AS BIGINT) AS volume, n FROM ({_TUM})")
add("st_adv_sliding", lambda x: T.settle(T.sliding(_events(x), "event_type", "3 days", "1 day"), "update", ["event_type", "start"]).withColumn("start", F.to_date("start")), "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) - k AS start, count(*) AS n, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS BIGINT) AS volume FROM events CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS k) GROUP BY 1, 2")
add("st_episode_sessions", lambda x: T.settle(T.sessions(_events(x), "user_id", "12 hours"), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events")), "WITH a AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true) AS new FROM events) SELECT user_id, count(*) FILTER (new) AS sessions, count(*) AS events FROM a GROUP BY user_id")
add("st_static_enrich", lambda x: T.settle(T.enrich(T.source(x.spark, x.dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"), "l_quantity"), x.table("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")).groupBy("s_nationkey").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n")), "SELECT s_nationkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
_SIGN = lambda: F.when(F.col("event_type") == "purchase", 1).otherwise(-1) * (F.col("event_id") % 5)
_UO = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
add(
    "st_positions", lambda x: T.settle(T.running_positions(_events(x).withColumn("q", _SIGN()).select("user_id", "ts", "event_id", "q", "value"), "user_id", "q", "value"), "update", ["user_id"]),
    f"""WITH u0 AS (SELECT user_id, ts, event_id, value AS p, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END * (event_id % 5) AS q FROM events), u1 AS (SELECT *, sum(q) {_UO} ROWS UNBOUNDED PRECEDING) AS after FROM u0),
    u2 AS (SELECT *, after - q AS before, sum(CAST(q <> 0 AND (after - q = 0 OR (after - q) * after < 0) AS INTEGER)) {_UO} ROWS UNBOUNDED PRECEDING) AS seg FROM u1),
    u3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS i FROM u2 QUALIFY seg = max(seg) OVER (PARTITION BY user_id)),
    u4 AS (SELECT *, CASE WHEN i = 1 AND q <> 0 THEN p WHEN before * q > 0 THEN p * q / after ELSE 0 END AS share, CASE WHEN i > 1 AND before * q > 0 THEN ln(CAST(before AS DOUBLE) / after) ELSE 0 END AS keeps FROM u3),
    u5 AS (SELECT *, coalesce(sum(keeps) {_UO} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM u4), u6 AS (SELECT user_id, sum(share * exp(later)) AS mean FROM u5 GROUP BY user_id),
    u7 AS (SELECT user_id, count(*) AS n, CAST(last(after ORDER BY ts, event_id) AS BIGINT) AS qty, CAST(max(abs(after)) AS BIGINT) AS peak FROM u1 GROUP BY user_id)
    SELECT user_id, n, qty, peak, {r('CASE WHEN qty = 0 THEN 0 ELSE mean END', 'avg_price')} FROM u7 JOIN u6 USING (user_id)""",
)

# covariance windows and learning
from panelweave.operators import covariance as K  # noqa: E402

_WIN = "kd AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM fx_days), kf AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(pos) AS loc FROM kd GROUP BY 1 HAVING min(pos) > 26), kr AS (SELECT kf.month, kd.date, f.ticker, f.ret FROM kf JOIN kd ON kd.pos BETWEEN loc - 26 AND loc - 1 JOIN fx_returns f ON f.date = kd.date AND f.ret IS NOT NULL), kw AS (SELECT month, date, ticker, ret FROM (SELECT *, count(*) OVER (PARTITION BY month, ticker) AS n FROM kr) WHERE n = 26)"
_rows = lambda x: K.window_rows(x.returns, 26)
add("window_matrix", lambda x: _rows(x).groupBy("month").agg(F.count_distinct("ticker").alias("names"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg("ret").alias("mean")), f"WITH {_WIN} SELECT month, count(DISTINCT ticker) AS names, min(date) AS first, max(date) AS last, {r('avg(ret)', 'mean')} FROM kw GROUP BY month")
add("cov_pairs", lambda x: K.cov_pairs(_rows(x)).withColumn("cov", F.col("cov") * 1e4), f"WITH {_WIN} SELECT x.month, x.ticker AS a, y.ticker AS b, {r('covar_samp(x.ret, y.ret) * 10000', 'cov')} FROM kw x JOIN kw y ON x.month = y.month AND x.date = y.date AND x.ticker <= y.ticker GROUP BY 1, 2, 3")
for _how in ("sample", "identity", "factor"):
    add(f"minvar_weights_{_how}", lambda x, how=_how: K.min_variance(_rows(x), how))
add("minvar_scoreboard", lambda x: K.scoreboard(K.min_variance(_rows(x), "identity"), x.returns, 52))
add("window_pca", lambda x: K.window_pca(_rows(x), 3))
_LSIG = "ls AS (SELECT signalname, date, ret / 100 AS ret FROM fx_signals WHERE port = 'LS'), lf AS (SELECT signalname, date, CASE WHEN count(ret) OVER k = 12 THEN sum(ret) OVER k END AS mom, CASE WHEN count(ret) OVER k = 12 THEN stddev_samp(ret) OVER k END AS vol, lead(ret) OVER (PARTITION BY signalname ORDER BY date) AS y FROM ls WINDOW k AS (PARTITION BY signalname ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"
_feat = lambda x: K.signal_features(U.long_short(x.signals, "1900-01-01"))
add("signal_features", _feat, f"WITH {_LSIG} SELECT signalname, date, {r('mom', 'mom')}, {r('vol', 'vol')}, {r('y', 'y')} FROM lf")
_OLS = "om AS (SELECT date, count(*) AS n, sum(mom) AS x, sum(y) AS v, sum(mom * y) AS xv, sum(mom * mom) AS xx FROM lf WHERE mom IS NOT NULL AND y IS NOT NULL GROUP BY date), oc AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, sum(n) OVER k AS n, sum(x) OVER k AS x, sum(v) OVER k AS v, sum(xv) OVER k AS xv, sum(xx) OVER k AS xx FROM om WINDOW k AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), ob AS (SELECT *, (xv * n - x * v) / nullif(xx * n - x * x, 0) AS b FROM oc), oa AS (SELECT *, (v - b * x) / n AS a FROM ob), ok AS (SELECT date, last_value(CASE WHEN i >= 24 AND (i - 24) % 12 = 0 THEN a END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN i >= 24 AND (i - 24) % 12 = 0 THEN b END IGNORE NULLS) OVER w AS b FROM oa WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))"
add("expanding_predict", lambda x: K.expanding_ols(_feat(x), 24, 12), f"WITH {_LSIG}, {_OLS} SELECT signalname, lf.date, {r('a + b * mom', 'prediction')} FROM lf JOIN ok USING (date) WHERE mom IS NOT NULL")

# strategy books
from panelweave.plans.books import BOOKS  # noqa: E402

_MK = "mk AS (SELECT date, 'MKT' AS ticker, ret, 100 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close FROM fx_market)"
_book = lambda name, kind="market": lambda x: BOOKS[name](x.market if kind == "market" else x.returns)
add("book_bench_buyhold", _book("bench_buyhold"), f"WITH {_MK} SELECT date, ticker, CAST(1 AS DOUBLE) AS w FROM mk")
_AB = f"ab AS (SELECT *, close / ({mean('close', 40)}) - 1 AS above FROM mk)"
add("book_bench_sma_2x", _book("bench_sma_2x"), f"WITH {_MK}, {_AB} SELECT date, ticker, CAST(CASE WHEN above > 0 THEN 2 ELSE 0 END AS DOUBLE) AS w FROM ab WHERE above IS NOT NULL")
add("book_trend_gated_2x", _book("trend_gated_2x"), f"WITH {_MK}, {_AB}, g AS (SELECT *, last_value(CASE WHEN above > 0.01 THEN 1 WHEN above < -0.01 THEN 0 END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS gate FROM ab) SELECT date, ticker, CAST(coalesce(gate, 0) * 2 AS DOUBLE) AS w FROM g WHERE above IS NOT NULL")
_TV = f"{_MK}, tv AS (SELECT date, ticker, greatest(0, least(2, 0.01 / nullif(({std('ret', 13)}) * sqrt(52.0), 0))) AS t0, {std('ret', 13)} AS sd FROM mk), tt AS (SELECT date, ticker, CASE WHEN sd IS NOT NULL THEN t0 END AS target FROM tv)"
_BND = "CASE WHEN o.target IS NOT NULL AND abs(o.target - {z}) > 0.1 THEN o.target ELSE {z} END"
add_fold("book_vol_managed", _book("vol_managed"), _recursive(_TV, "tt", _BND.format(z="CAST(0 AS DOUBLE)"), _BND.format(z="z.st"), f" SELECT date, ticker, {r('st', 'w')} FROM z"))
_DM = "dm AS (SELECT date, sector AS ticker, avg(ret) AS ret FROM fx_returns GROUP BY 1, 2), dn AS (SELECT date, ticker, CASE WHEN count(ret) OVER k = 52 THEN round(exp(sum(ln(1 + ret)) OVER k) - 1, 9) END AS mom FROM dm WINDOW k AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))"
add("book_dual_momentum", _book("dual_momentum", "panel"), f"WITH {_DM} SELECT date, CASE WHEN max(mom) > 0 THEN first(ticker ORDER BY mom DESC, ticker) ELSE 'CASH' END AS ticker, CAST(1 AS DOUBLE) AS w FROM dn WHERE mom IS NOT NULL GROUP BY date")
_TS = f"ts AS (SELECT date, ticker, close / {lag('close', 26)} - 1 AS mom, {std('ret', 13)} AS sd FROM fx_returns), tr AS (SELECT date, ticker, sign(mom) / (sd * sqrt(52.0)) AS w0 FROM ts WHERE mom IS NOT NULL AND sd > 0)"
add("book_tsmom_multi_asset", _book("tsmom_multi_asset", "panel"), f"WITH {_TS} SELECT date, ticker, {r('w0 / nullif(sum(abs(w0)) OVER (PARTITION BY date), 0)', 'w')} FROM tr")

# stress, nulls, gates and further ledger rules
_HELD = lambda n: f"SELECT book, date, ticker, coalesce(lag(w, {n}) OVER k, 0) AS held, abs(coalesce(lag(w, {n}) OVER k, 0) - coalesce(lag(w, {n + 1}) OVER k, 0)) AS traded FROM fx_held0 WINDOW k AS (PARTITION BY book, ticker ORDER BY date)"
_DAY = lambda n, ret: f"SELECT book, date, coalesce(sum(held * {ret}), 0) AS gross, sum(traded) * 0.001 AS cost FROM ({_HELD(n)}) LEFT JOIN rt USING (date, ticker) GROUP BY 1, 2"
_RT = "rt AS (SELECT date, ticker, ret, lead(open) OVER (PARTITION BY ticker ORDER BY date) / open - 1 AS oo FROM fx_returns)"
add("stress_grid", lambda x: L.stress_grid(x.weights, x.returns.select(*DT, "ret"), x.calendar.select("date"), 10.0, [1, 2], [0.5, 2.0, 4.0]), f"WITH {_RT}, d AS (SELECT 1 AS delay, * FROM ({_DAY(1, 'ret')}) UNION ALL SELECT 2, * FROM ({_DAY(2, 'ret')})) SELECT book, delay, multiple, {r('sum(gross - cost * multiple)', 'total')}, {r('min(gross - cost * multiple)', 'worst')} FROM d CROSS JOIN (SELECT CAST(unnest([0.5, 2, 4]) AS DOUBLE) AS multiple) GROUP BY 1, 2, 3")
add("fill_point_arms", lambda x: L.fill_points(x.weights, x.returns, x.calendar.select("date")), f"WITH {_RT}, a AS (SELECT book, avg(gross) AS p FROM ({_DAY(1, 'oo')}) GROUP BY 1), c AS (SELECT book, avg(gross) AS q FROM ({_DAY(2, 'ret')}) GROUP BY 1) SELECT book, {r('p', 'at_open')}, {r('q', 'at_close')} FROM a JOIN c USING (book)")
add("target_book", lambda x: L.target_book(_bands(x)), f"WITH {_BANDS} SELECT date, ticker, CAST(position AS INTEGER) AS position, {r('position / CAST(count(*) OVER () AS DOUBLE)', 'w')} FROM p3 WHERE date = (SELECT max(date) FROM p3) AND position <> 0")
add("frozen_replication", lambda x: L.replication(x.nets, x.returns.groupBy("date").agg(F.avg("ret").alias("mkt"), (F.avg(F.when(F.col("sector") == "ASIA", F.col("ret"))) - F.avg(F.when(F.col("sector") == "EUROPE", F.col("ret")))).alias("hml")).select("date", F.expr("stack(2, 'mkt', mkt, 'hml', hml)").alias("factor", "value")), {"bk_ew": {"mkt": 1.0}, "bk_rot": {"mkt": 0.9, "hml": 0.3}}), f"WITH {_FF}, e AS (SELECT book, date, CASE book WHEN 'bk_ew' THEN mkt ELSE coalesce(0.9 * mkt + 0.3 * hml, 0.9 * mkt, 0.3 * hml) END AS x, net FROM fx_nets JOIN ff USING (date) WHERE book IN ('bk_ew', 'bk_rot')) SELECT book, date, {r('x', 'explained')}, {r('net - x', 'residual')} FROM e")
_ser = lambda x, b: x.nets.where(F.col("book") == b).select((F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("pos"), F.col("net").alias("v"))
add("shift_null", lambda x: M.shift_null(_ser(x, "bk_ew"), _ser(x, "bk_rot")), f"WITH a AS (SELECT row_number() OVER (ORDER BY date) - 1 AS pos, net AS x FROM fx_nets WHERE book = 'bk_ew'), b AS (SELECT row_number() OVER (ORDER BY date) - 1 AS pos, net AS y FROM fx_nets WHERE book = 'bk_rot'), n AS (SELECT count(*) AS n FROM a) SELECT shift, {r('pow(covar_pop(x, y), 2) / nullif(var_pop(x) * var_pop(y), 0)', 'r2')} FROM a CROSS JOIN n JOIN range(1, 2000) s(shift) ON shift < n JOIN b ON b.pos = (a.pos + shift) % n GROUP BY shift")
_CO = lambda p, q: f"CASE WHEN var_pop({p}) FILTER ({q} IS NOT NULL) > 1e-18 AND var_pop({q}) FILTER ({p} IS NOT NULL) > 1e-18 THEN covar_pop({p}, {q}) / sqrt(var_pop({p}) FILTER ({q} IS NOT NULL) * var_pop({q}) FILTER ({p} IS NOT NULL)) END"
add("vol_clustering_props", lambda x: M.vol_clustering(x.returns.where("ret is not null").withColumn("ret", F.col("ret") * 100)), f"WITH a AS (SELECT ticker, date, ret * 100 AS ret, ret * ret * 10000 AS s FROM fx_returns WHERE ret IS NOT NULL), b AS (SELECT *, lag(s) OVER (PARTITION BY ticker ORDER BY date) AS p, lead(s) OVER (PARTITION BY ticker ORDER BY date) - s AS d FROM a) SELECT ticker, {r(_CO('s', 'p'), 'clustering')}, {r(_CO('ret', 'd'), 'leverage')} FROM b GROUP BY ticker")
add("carry_snapshot", lambda x: O.carry_snapshot(x.nets.where("date < date'1999-01-01'").select("book", "date", (F.col("net") + 1).alias("net")), x.nets.select("book", "date", "net", "gross"), ["book", "date"], ["net"]), f"SELECT book, date, {r('CASE WHEN date < DATE ' + chr(39) + '1999-01-01' + chr(39) + ' THEN net + 1 ELSE net END', 'net')}, {r('gross', 'gross')} FROM fx_nets")
_modes = lambda x: x.nets.select("book", "date", F.lit("dry").alias("mode"), F.col("net").alias("ret")).unionByName(x.nets.where("month(date) < 7").select("book", "date", F.lit("live").alias("mode"), F.when(F.month("date") != 3, F.col("gross")).alias("ret")))
add("book_daily_returns", lambda x: O.prefer_live(_modes(x)), f"SELECT book, date, CASE WHEN month(date) < 7 AND month(date) <> 3 THEN 'live' ELSE 'dry' END AS mode, {r('CASE WHEN month(date) < 7 AND month(date) <> 3 THEN gross ELSE net END', 'ret')} FROM fx_nets")
add("exec_side_split", lambda x: O.side_split(x.fills, x.market), f"SELECT side, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS tape, count(*) AS fills, {r(f'avg({_SLIP})', 'mean_bps')} FROM fx_fills JOIN fx_market m ON m.date = week WHERE filled_qty > 0 AND ret IS NOT NULL GROUP BY 1, 2")
# exact multiples of five basis points sit on the limit, so the alarm limit of 15 is compared after the same arithmetic on both sides
_CHECKS = {"rate": "fill_rate >= 0.6", "rejects": "rejected = 0", "slippage": "abs(round(slip_bps, 6)) <= 15"}
add("flatten_gate", lambda x: O.gate(O.reconcile(x.fills), _CHECKS).select("session", "binding", "verdict"), f"WITH {_REC} SELECT session, CASE WHEN fill_rate < 0.6 THEN 'rate' WHEN rejected > 0 THEN 'rejects' WHEN abs(round(slip_bps, 6)) > 15 THEN 'slippage' END AS binding, CASE WHEN fill_rate < 0.6 OR rejected > 0 OR abs(round(slip_bps, 6)) > 15 THEN 'FAIL' WHEN fill_rate IS NULL OR slip_bps IS NULL THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict FROM rd")
add("weight_leakage", lambda x: V.truncation_audit(C.quantile_weights(_mom(x), 5, "mom"), C.quantile_weights(_mom_cut(x), 5, "mom"), list(DT), "w"), f"WITH {_BUCKET} SELECT count(*) AS cells, CAST(0 AS BIGINT) AS leaks, 'PASS' AS verdict FROM q1 WHERE n >= 5 AND bucket IN (0, 4) AND date < DATE '1999-01-01'")
add("parity_check", lambda x: J.gaps(C.quantile_weights(_mom(x), 5, "mom").where("date < date'1999-01-01'"), C.quantile_weights(_mom_cut(x), 5, "mom"), list(DT), "w", 1e-9).agg(F.count("*").alias("gaps")), "SELECT CAST(0 AS BIGINT) AS gaps")
add("st_last_mark", lambda x: T.settle(_events(x).groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")), "update", ["user_id", "event_type"]), f"SELECT user_id, event_type, {r('last(value ORDER BY ts, event_id)', 'value')} FROM events GROUP BY 1, 2")

# further queries, which register themselves
from panelweave.plans import catalog_alphas, catalog_books, catalog_clusters, catalog_events, catalog_execution, catalog_inference, catalog_jobs, catalog_ladder, catalog_macro, catalog_more, catalog_panel, catalog_spectrum, catalog_timing  # noqa: E402, F401
