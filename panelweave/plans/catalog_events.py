"""Registered queries of terminal events and of days with late restatements, in batch and as streams over several batches, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import by
from panelweave.operators import state as P
from panelweave.plans.fixtures import Fixtures
from panelweave.plans.registry import add
from panelweave.streaming import jobs as T
from panelweave.streaming import stateful as Z

LIMIT = 5


def _held(x: Fixtures) -> DataFrame:
    """What a book's holder sees of each name and week: the panel, with halts, delistings, unknown states and corporate actions on weeks that their number picks."""
    p = x.panel.withColumn("pos", F.row_number().over(by("ticker"))).withColumn("num", F.substring("ticker", 2, 9).cast("int"))
    h = F.col("pos") * 7 + F.col("num") * 13
    away = F.col("close").isNull()
    status = F.when(away & (h % 5 == 0), "delisted").when(away | ((F.floor(F.col("pos") / 7) + F.col("num")) % 9 == 0), "halted").when(h % 97 == 0, "unknown").otherwise("tradable")
    event = F.when(h % 89 == 0, "symbol_change").when(h % 101 == 0, "merger_cash").when(h % 61 == 0, "dividend")
    return p.select(
        "date", "ticker", status.alias("status"), F.col("member").alias("in_index"), F.when(F.col("num") % 3 == 0, "NEW").alias("successor"), event.alias("event"),
        "open", (F.lag("close").over(by("ticker")) * 0.99).alias("floor"), F.when(F.col("num") % 2 == 0, "long").otherwise("short").alias("side"),
    )


_RUNGS = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos, CAST(substr(ticker, 2, 9) AS INTEGER) AS num, lag(close) OVER (PARTITION BY ticker ORDER BY date) * 0.99 AS floor FROM fx_panel), q AS (SELECT *, pos * 7 + num * 13 AS h FROM p),
e AS (SELECT date, ticker, open, floor, member, num % 3 = 0 AS moved, num % 2 = 0 AS long, CASE WHEN h % 89 = 0 THEN 'symbol_change' WHEN h % 101 = 0 THEN 'merger_cash' WHEN h % 61 = 0 THEN 'dividend' END AS event,
CASE WHEN close IS NULL AND h % 5 = 0 THEN 'delisted' WHEN close IS NULL OR (pos // 7 + num) % 9 = 0 THEN 'halted' WHEN h % 97 = 0 THEN 'unknown' ELSE 'tradable' END AS status FROM q),
a AS (SELECT *, coalesce(event = 'symbol_change', false) AND moved AS follow, coalesce(event IN ('merger_cash', 'acquisition_cash'), false) AS paid FROM e),
b AS (SELECT *, NOT follow AND NOT paid AND status = 'halted' AS halted, NOT follow AND NOT paid AND status = 'tradable' AS up, NOT follow AND NOT paid AND status = 'delisted' AND NOT member AND NOT moved AS gone FROM a),
c AS (SELECT *, count(*) FILTER (follow OR paid OR up OR gone) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg FROM b),
d AS (SELECT *, CASE WHEN halted THEN count(*) FILTER (halted) OVER (PARTITION BY ticker, seg ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 0 END AS days FROM c),
f AS (SELECT date, ticker, CAST(days AS INTEGER) AS days, CASE WHEN follow THEN 'corporate_action_follow' WHEN paid THEN 'corporate_action' WHEN up AND long AND coalesce(open < floor, false) THEN 'gap_stop' WHEN up THEN 'still_open' WHEN halted AND member AND days <= 5 THEN 'halt' WHEN gone THEN 'delisted' ELSE 'quarantine' END AS reason FROM d)"""
add(
    "terminal_events", lambda x: P.terminal_events(_held(x), LIMIT).select("date", "ticker", "days", "reason", "keep", "dead"),
    f"{_RUNGS} SELECT date, ticker, days, reason, reason NOT IN ('delisted', 'corporate_action', 'corporate_action_follow', 'gap_stop') AS keep, reason IN ('delisted', 'corporate_action', 'gap_stop') AS dead FROM f",
)
_batch = lambda: F.when(F.col("date") < "1996-01-01", 0).when(F.col("date") < "1998-07-01", 1).otherwise(2)
add("st_terminal_events", lambda x: T.settle(Z.terminal_events(T.arriving(_held(x).withColumn("_b", _batch()), "_b", 3), LIMIT)), f"{_RUNGS} SELECT date, ticker, reason FROM f")


def _restated(x: Fixtures) -> DataFrame:
    """The events in four batches by time; one in fifty comes with the last."""
    e = x.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    part = F.least(F.lit(3), F.floor((F.unix_micros("ts") - F.unix_micros("lo")) * 4 / (F.unix_micros("hi") - F.unix_micros("lo")))).cast("int")
    e = e.crossJoin(F.broadcast(ends)).withColumn("_b", F.when(F.col("event_id") % 50 == 0, 3).otherwise(part)).drop("lo", "hi")  # one row of ends
    done, late = T.embargoed_ledger(T.arriving(e, "_b", 4), "event_type", "value", "2 days")
    both = done.join(late, ["event_type", "day"], "full")
    return both.select("event_type", F.to_date("day").alias("day"), "n", "total", F.coalesce("late_n", F.lit(0).cast("long")).alias("late_n"), F.coalesce("late_total", F.lit(0).cast("long")).alias("late_total"))


add(
    "st_embargo_ledger", _restated,
    """WITH x AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), e AS (SELECT event_type, ts, date_trunc('day', ts) AS day, CAST(round(value * 10000) AS BIGINT) AS v, CASE WHEN event_id % 50 = 0 THEN 3 ELSE least(3, CAST(floor((epoch_us(ts) - lo) * 4 / (hi - lo)) AS INTEGER)) END AS b FROM events, x),
    f AS (SELECT b, max(max(ts)) OVER (ORDER BY b) AS newest FROM e GROUP BY b), g AS (SELECT e.*, day + INTERVAL 1 DAY <= (SELECT newest FROM f WHERE f.b = e.b - 1) - INTERVAL 2 DAY AS late FROM e),
    d AS (SELECT event_type, day, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM g WHERE NOT coalesce(late, false) AND day + INTERVAL 1 DAY <= (SELECT max(newest) FROM f) - INTERVAL 2 DAY GROUP BY 1, 2),
    l AS (SELECT event_type, day, count(*) AS late_n, CAST(sum(v) AS BIGINT) AS late_total FROM g WHERE late GROUP BY 1, 2)
    SELECT event_type, CAST(day AS DATE) AS day, n, total, coalesce(late_n, 0) AS late_n, coalesce(late_total, 0) AS late_total FROM d FULL JOIN l USING (event_type, day)""",
)
