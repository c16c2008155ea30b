"""Operators against plain loops on small random panels."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.functions.columns import average_rank
from panelweave.operators import covariance, joins, ledger, state, universe
from panelweave.plans.books import BOOKS, register_book
from panelweave.sources import readers

DAY = dt.date(2020, 1, 1)


def panel(spark, series, name="s", kind="double"):
    rows = [(k, DAY + dt.timedelta(days=i), v) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ticker string, date date, {name} {kind}")


def column(df, name):
    out = {}
    for r in df.orderBy("ticker", "date").collect():
        out.setdefault(r.ticker, []).append(r[name])
    return out


@pytest.fixture(scope="module")
def series():
    r = random.Random(4)
    return {f"T{k}": [None if r.random() < 0.05 else r.gauss(0, 1.5) for _ in range(120)] for k in range(12)}


def loop(values, entry, leave, floor=-math.inf):
    s, out = 0, []
    for v in values:
        if v is not None:
            if s == 0:
                s = -1 if v >= entry else 1 if v <= -entry and v > floor else 0
            elif abs(v) <= leave or (s == 1 and v <= floor):
                s = 0
        out.append(s)
    return out


def test_bands_window_fold_and_loop_agree(spark, series):
    df = panel(spark, series)
    assert column(state.band_positions(df, 1.5, 0.5), "position") == {k: loop(v, 1.5, 0.5) for k, v in series.items()}
    assert column(state.band_positions_floor(df, 1.5, 0.5, -2.5), "position") == {k: loop(v, 1.5, 0.5, -2.5) for k, v in series.items()}


def test_tolerance_band_and_halving(spark, series):
    held, waits = {}, {}
    for k, values in series.items():
        h, w, out, gate = 0.0, 0, [], []
        for v in values:
            if v is not None and abs(v - h) > 1:
                h = v
            if v is not None:
                w = 3 if v >= 2 else max(w - 1, 0) if v < 1 else 3 if w else 0
            out.append(h)
            gate.append(0.5 if w else 1.0)
        held[k], waits[k] = out, gate
    assert column(state.tolerance_band(panel(spark, series, "target"), 1.0), "held") == held
    assert column(state.halving_gate(panel(spark, series, "v"), 2.0, 1.0, 3), "exposure") == waits


def test_asof_both_ways(spark):
    r = random.Random(1)
    left = [(r.choice("ab"), r.randint(0, 50)) for _ in range(60)]
    right = [(k, t, f"{k}{t}") for k, t in {(r.choice("ab"), r.randint(0, 50)) for _ in range(25)}]
    l, rt = spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, u int, v string")  # noqa: E741
    for direction, strict in (("backward", False), ("backward", True), ("forward", False), ("forward", True)):
        def best(k, t, back=direction == "backward", strict=strict):
            ok = [u for key, u, _ in right if key == k and (u < t or u == t and not strict if back else u > t or u == t and not strict)]
            return f"{k}{(max if back else min)(ok)}" if ok else None

        got = joins.asof(l, rt, ["k"], "t", "u", "v", direction, strict).collect()
        assert sorted((x.k, x.t, str(x.v)) for x in got) == sorted((k, t, str(best(k, t))) for k, t in left)


def test_average_entry_resets_on_a_flip(spark):
    fills = [("A", DAY, "1", "buy", 10.0, 10.0), ("A", DAY, "2", "buy", 10.0, 20.0), ("A", DAY, "3", "sell", 5.0, 99.0), ("A", DAY, "4", "sell", 25.0, 30.0), ("B", DAY, "1", "buy", 1.0, 5.0), ("B", DAY, "2", "sell", 1.0, 6.0)]
    df = spark.createDataFrame(fills, "ticker string, session date, client_order_id string, side string, filled_qty double, price double")
    assert {r.ticker: (r.qty, r.avg_price) for r in ledger.average_entry(df).collect()} == {"A": (-10.0, 30.0), "B": (0.0, 0.0)}


def test_average_rank_is_pandas_rank(spark):
    values = [3.0, 1.0, None, 3.0, 2.0, 3.0, None]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    got = [r.k for r in df.select("i", average_rank("v", "g").alias("k")).orderBy("i").collect()]
    assert [math.nan if k is None else k for k in got] == pytest.approx(pd.Series(values).rank().tolist(), nan_ok=True)


def test_membership_keeps_the_last_snapshot_of_a_date(spark):
    changes = spark.createDataFrame([(DAY, ["A"], 1), (DAY, ["B"], 2), (DAY + dt.timedelta(days=2), ["A", "B"], 1)], "date date, members array<string>, arrival int")
    grid = spark.createDataFrame([(DAY + dt.timedelta(days=i), t) for i in range(-1, 4) for t in "AB"], "date date, ticker string")
    got = {((r.date - DAY).days, r.ticker) for r in universe.membership_mask(changes, grid).where("member").collect()}
    assert got == {(0, "B"), (1, "B"), (2, "A"), (2, "B"), (3, "A"), (3, "B")}


def test_shrinkage_lies_between_its_ends():
    r = np.random.default_rng(0).normal(size=(40, 6))
    sample = np.cov(r, rowvar=False, ddof=0)
    got = covariance.shrunk(r, "identity")
    assert np.trace(got) == pytest.approx(np.trace(sample)) and np.linalg.cond(got) < np.linalg.cond(sample)
    assert np.allclose(covariance.shrunk(r, "sample"), np.cov(r, rowvar=False))


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("header",), (" 20200102 , 1.5,-0.5",), ("",), ("Copyright",)], "value string")
    assert [tuple(r) for r in readers.parse_factors(lines, ["a", "b"]).collect()] == [(dt.date(2020, 1, 2), 0.015, -0.005)]
    ledger_lines = spark.createDataFrame([('{"k": 1}',), ("  ",), ('{"k": ',)], "value string")
    assert sorted((r.k or 0, r.torn) for r in readers.parse_ledger(ledger_lines, "k long").collect()) == [(0, True), (1, False)]
    df = spark.createDataFrame([(DAY, "A", 1.0, 2.0, 3.0, True)], readers.PANEL)
    readers.write_panel(df, f"{tmp_path}/p")
    assert readers.read_panel(spark, f"{tmp_path}/p").drop("year").collect() == df.collect()
    with pytest.raises(Exception, match="exists"):
        readers.write_panel(df, f"{tmp_path}/p")
    readers.register(spark, f"{tmp_path}/m", "x", "y", 3, {"a": "b"})
    assert spark.read.json(f"{tmp_path}/m").first()["rows"] == 3
    with pytest.raises(ValueError):
        readers.register(spark, f"{tmp_path}/m", "x", "y", 3, n_trials=0)


def test_books_register_once():
    register_book("mine", lambda p: p)
    with pytest.raises(ValueError):
        register_book("mine", lambda p: p)
    BOOKS.pop("mine")


def test_folds_stream_a_long_key(spark):
    """One key holds nearly all rows; the state is carried over Arrow batches."""
    from panelweave.operators import state as P

    n = 100_000
    rows = spark.range(n).select(F.lit("hot").alias("ticker"), F.col("id").alias("date"), F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") * 7919 % 1000) / 100).alias("target"))
    rows = rows.unionByName(spark.createDataFrame([("cold", 0, 1.0), ("cold", 1, None)], "ticker string, date long, target double"))
    got = {(r.ticker, r.date): r.held for r in P.tolerance_band(rows, 4.0).collect()}
    held = 0.0
    for i in range(n):
        x = None if i % 7 == 0 else i * 7919 % 1000 / 100
        held = x if x is not None and abs(x - held) > 4.0 else held
        assert got["hot", i] == held
    assert got["cold", 0] == 0.0 and got["cold", 1] == 0.0 and len(got) == n + 2


def test_average_entry_follows_a_loop(spark):
    from random import Random

    from panelweave.operators import ledger as O

    r, rows = Random(4), []
    for t in ("A", "B", "C"):
        for i in range(400):
            rows.append((t, f"2001-{1 + i // 40:02d}-{1 + i % 28:02d}", f"{i:05d}", r.choice(["buy", "sell"]), float(r.randrange(0, 5)), 10 + r.random()))
    rows += [("D", "2001-01-01", "1", "buy", 5.0, 3.0), ("D", "2001-02-01", "2", "sell", 5.0, 4.0), ("E", "2001-01-01", "1", "buy", 2.0, 3.0), ("E", "2001-03-01", "2", "sell", 6.0, 4.0)]
    frame = spark.createDataFrame(rows, "ticker string, session string, client_order_id string, side string, filled_qty double, price double").withColumn("session", F.to_date("session"))
    got = {x.ticker: (x.qty, x.avg_price) for x in O.average_entry(frame).collect()}
    for t in "ABCDE":
        q = p = 0.0
        for _, _, _, side, n, price in sorted((x for x in rows if x[0] == t and x[4] > 0), key=lambda x: (x[1], x[2])):
            move = n if side == "buy" else -n
            after = q + move
            p = 0.0 if after == 0 else price if q == 0 or q * after < 0 else (p * q + price * move) / after if q * move > 0 else p
            q = after
        assert got[t][0] == q and abs(got[t][1] - p) < 1e-9, t


def test_average_entry_of_one_crowded_day(spark):
    from panelweave.operators import ledger as O

    n = 3000
    rows = [("A", DAY, f"{i:05d}", "buy" if i % 3 else "sell", 1.0 + i % 4, 10.0 + i % 11) for i in range(n)] + [("A", DAY + dt.timedelta(days=1), "0", "buy", 2.0, 7.0)]
    q = p = 0.0
    for _, _, _, side, size, price in rows:
        move = size if side == "buy" else -size
        p = price if q == 0 or q * (q + move) < 0 else (p * q + price * move) / (q + move) if q * move > 0 else p
        q += move
    out = O.average_entry(spark.createDataFrame(rows, "ticker string, session date, client_order_id string, side string, filled_qty double, price double"))
    (got,) = out.collect()
    assert got.qty == q and got.avg_price == pytest.approx(p, abs=1e-9)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()  # such a frame costs the square of its rows


def test_pooled_rank_is_the_rank_over_all_rows(spark):
    from panelweave.operators import cross_section as C

    rows = spark.range(3000).select((F.col("id") * 7919 % 97).cast("double").alias("v"), "id")
    got = {r.id: r.k for r in C.pooled_rank(rows, "v", "k").collect()}
    values = sorted(i * 7919 % 97 for i in range(3000))
    first = {v: values.index(v) for v in set(values)}
    count = {v: values.count(v) for v in set(values)}
    assert all(got[i] == first[i * 7919 % 97] + (count[i * 7919 % 97] + 1) / 2 for i in range(3000))


def test_a_mean_at_the_limit_is_no_breach(spark):
    means = [("A", 20, 3.0000000000001146, True), ("B", 20, -3.0000000000001137, True), ("C", 20, 2.9999999999998375, True), ("D", 20, -3.25, True), ("E", 7, 3.0000000000000036, True), ("F", 7, 3.25, True), ("G", 3, 9.0, True), ("H", 20, 9.0, False)]
    frame = spark.createDataFrame(means, "ticker string, n long, mean_bps double, fresh boolean")
    got = {r.ticker: r.alarm for r in ledger.slippage_alarms(frame, 3.0, 5, 20).collect()}
    assert got == {"A": "ok", "B": "ok", "C": "ok", "D": "breach", "E": "provisional", "F": "provisional_breach", "G": "untested", "H": "stale"}
