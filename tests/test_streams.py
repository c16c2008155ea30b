"""Streams over several batches: the same rows as in one, late ones put aside, nothing written twice."""

import datetime as dt
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.operators import state as P
from panelweave.streaming import jobs as T
from panelweave.streaming import stateful as Z

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("_b", F.ntile(5).over(Window.orderBy("ts", "event_id")) - 1).cache()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def both(events, run, mixed=False):
    """run over one batch and over five: in order of time with the rows of a batch mixed up, or (mixed) in no order."""
    five = events.withColumn("_b", F.pmod(F.xxhash64("event_id"), F.lit(5)).cast("int")) if mixed else events
    one = run(T.arriving(events.withColumn("_b", F.lit(0)), "_b", 1))
    return rows(one), rows(run(T.arriving(five.orderBy(F.xxhash64("event_id")), "_b", 5)))


@pytest.mark.parametrize("stretch", [1, 4])
def test_first_arrivals_stay_first(events, stretch):
    first = events.agg(F.min("ts")).first()[0]
    far = events.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(first)) + (F.unix_micros("ts") - F.unix_micros(F.lit(first))) * stretch))
    want = rows(events.select("user_id", "event_type").distinct())
    assert both(far, lambda s: T.settle(T.first_arrivals(s, "user_id", "event_type")), mixed=True) == (want, want)
    assert both(far, lambda s: T.settle(T.first_arrivals(s, "user_id", "event_type"))) == (want, want)


def test_a_horizon_forgets(events):
    _, five = both(events, lambda s: T.settle(T.first_arrivals(s, "user_id", "event_type", horizon="1 days")))
    assert sum(five.values()) > len(five) == events.select("user_id", "event_type").distinct().count()


def test_state_machines_carry_their_state(events):
    value = lambda s: s.select("user_id", "ts", "event_id", ((F.col("value") - 60) / 30).alias("v"))
    for start, kinds, step in (((0,), "p int", Z.bands(1.25, 0.5)), ((0,), "n int", Z.counter(lambda v: v > 0)), ((-1,), "last int", Z.on_change)):
        one, five = both(events, lambda s, a=(start, kinds, step): T.settle(Z.state_machine(value(s), "user_id", "v", *a)))
        assert one == five and sum(one.values()) > 30


def test_positions_end_alike(events):
    held = lambda s: T.running_positions(s.select("user_id", "ts", "event_id", (F.col("event_id") % 7 - 3).alias("q"), "value"), "user_id", "q", "value")
    one, five = both(events, lambda s: T.settle(held(s), "update", ["user_id"]).withColumn("avg_price", F.round("avg_price", 6)))
    assert one == five


def test_bars_and_sessions_of_unordered_batches(events):
    for run in (
        lambda s: T.settle(T.tumbling(s, "event_type", "value", "1 day", "90 days"), "update", ["event_type", "start"]),
        lambda s: T.settle(T.sliding(s, "event_type", "3 days", "1 day", "90 days"), "update", ["event_type", "start"]),
    ):
        one, five = both(events, run, mixed=True)
        assert one == five and sum(one.values()) > 10


def test_late_restatements_are_put_aside(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    batches = [[(day(1), "a", 1.0), (day(1, 5), "a", 2.0), (day(2), "b", 5.0)], [(day(5), "a", 1.0), (day(1, 9), "a", 4.0)], [(day(1, 7), "a", 100.0), (day(2, 3), "b", 7.0), (day(9), "b", 1.0)], [(day(5, 3), "a", 0.5), (day(2, 4), "b", 1.5)]]
    frame = spark.createDataFrame([(*r, i) for i, b in enumerate(batches) for r in b], "ts timestamp, k string, v double, _b int")
    done, late = T.embargoed_ledger(T.arriving(frame, "_b", 4), "k", "v", "2 days")
    # the first of January closes with the second batch, whose own late row still counts
    assert rows(done.selectExpr("k", "date(day)", "n", "total")) == Counter([("a", dt.date(2024, 1, 1), 3, 70000), ("b", dt.date(2024, 1, 2), 1, 50000), ("a", dt.date(2024, 1, 5), 1, 10000)])
    assert rows(late.selectExpr("k", "date(day)", "late_n", "late_total")) == Counter([("a", dt.date(2024, 1, 1), 1, 1000000), ("b", dt.date(2024, 1, 2), 2, 85000), ("a", dt.date(2024, 1, 5), 1, 5000)])


def test_an_empty_ledger(spark):
    none = spark.createDataFrame([], "ts timestamp, k string, v double, _b int")
    done, late = T.embargoed_ledger(T.arriving(none, "_b", 1), "k", "v", "2 days")
    assert done.count() == late.count() == 0


LADDER = [
    ("halted", True, None, None, None, None, "halt", 1), ("halted", True, None, None, None, None, "halt", 2), ("delisted", True, None, None, None, None, "quarantine", 0), ("halted", None, None, None, None, None, "quarantine", 3),
    ("tradable", True, None, None, 9.0, 10.0, "gap_stop", 0), ("halted", False, None, None, None, None, "quarantine", 1), ("odd", True, None, None, None, None, "quarantine", 0), ("halted", True, None, "dividend", None, None, "halt", 2),
    ("halted", True, "NEW", "symbol_change", None, None, "corporate_action_follow", 0), ("halted", True, None, "symbol_change", None, None, "halt", 1), ("delisted", False, "NEW", None, None, None, "quarantine", 0), ("delisted", False, None, None, None, None, "delisted", 0),
    ("halted", True, None, None, None, None, "halt", 1), ("tradable", True, None, "merger_cash", None, None, "corporate_action", 0), ("tradable", True, None, None, None, 10.0, "still_open", 0), ("tradable", True, None, None, 11.0, 10.0, "still_open", 0), (None, True, None, None, None, None, "quarantine", 0),
]


def test_ladder_in_batch_and_stream(spark):
    data = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), t, *r[:6], side, i // 6) for t, side in (("L", "long"), ("S", "short")) for i, r in enumerate(LADDER)]
    frame = spark.createDataFrame(data, "date date, ticker string, status string, in_index boolean, successor string, event string, open double, floor double, side string, _b int")
    got = defaultdict(list)
    for r in P.terminal_events(frame, 2).orderBy("ticker", "date").collect():
        got[r["ticker"]].append((r["reason"], r["days"]))
        assert r["keep"] == (r["reason"] in ("halt", "quarantine", "still_open")) and r["dead"] == (r["reason"] in ("delisted", "corporate_action", "gap_stop"))
    assert got["L"] == [r[6:] for r in LADDER]
    assert got["S"] == [("still_open", 0) if r[6] == "gap_stop" else r[6:] for r in LADDER]
    streamed = T.settle(Z.terminal_events(T.arriving(frame, "_b", 3), 2))
    assert rows(streamed.select("ticker", "date", "reason")) == rows(P.terminal_events(frame, 2).select("ticker", "date", "reason"))
