"""Timing verdicts against dense regressions, placebo gates against what they promise."""

import datetime as dt
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest

from panelweave.operators import timing as Q
from panelweave.operators.inference import positions

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(90)]


def hac(x, u, lags):
    inv = np.linalg.inv(x.T @ x)
    g = x * u[:, None]
    meat = g.T @ g
    for k in range(1, lags + 1):
        c = g[k:].T @ g[:-k]
        meat += (1 - k / (lags + 1)) * (c + c.T)
    return inv @ meat @ inv


def test_difference_knows_the_covariance(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(0, 0.02, 90)
    common = rng.normal(0, 0.01, 90)
    books = {"parent": 0.5 * m + 2 * m * m + common, "child": 0.8 * m + 9 * m * m + common + rng.normal(0, 0.001, 90)}
    rows = [(b, d, float(v), float(f)) for b, y in books.items() for i, (d, v, f) in enumerate(zip(DAYS, y, m, strict=True)) if not (b == "child" and i < 10)]
    frame = spark.createDataFrame([*rows, ("child", DAYS[0], None, 0.1)], "book string, date date, net double, m double")
    gross = spark.createDataFrame([("parent", 1.0), ("child", 1.5)], "book string, gross double")
    got = {r["book"]: r for r in Q.timing_verdicts(frame, gross, spark.createDataFrame([("child", "parent")], "book string, parent string"), 3, 252, sims=20, mean_block=5).collect()}
    x = np.column_stack([np.ones(90), m, m * m])
    for b, own in (("parent", slice(0, 90)), ("child", slice(10, 90))):
        beta = np.linalg.lstsq(x[own], books[b][own], rcond=None)[0]
        se = hac(x[own], books[b][own] - x[own] @ beta, 3)[2, 2] ** 0.5
        var = (m[own] ** 2).mean() * 252
        r = got[b]
        assert np.allclose([r["gamma"], r["t"], r["value"], r["alpha"], r["least_value"]], [beta[2], beta[2] / se, beta[2] * var, beta[0] * 252, 2.84 * se * var])
        assert np.isclose(r["stressed"], beta[0] * 252 + beta[2] * var - max(gross.where(f"book = '{b}'").first()["gross"] - 1, 0) * 0.005)
    x, a, b = x[10:], books["child"][10:], books["parent"][10:]
    fit = [np.linalg.lstsq(x, y, rcond=None)[0] for y in (a, b)]
    u = (a - x @ fit[0]) - (b - x @ fit[1])
    assert np.isclose(got["child"]["difference"], fit[0][2] - fit[1][2]) and np.isclose(got["child"]["difference_se"], hac(x, u, 3)[2, 2] ** 0.5)
    assert got["child"]["distinct"] and got["child"]["beats_parent"] and got["child"]["verdict"] == "strong" and got["child"]["boot_p"] == 0
    assert got["parent"]["difference"] is None and got["parent"]["beats_parent"] is None


@pytest.fixture(scope="module")
def gate(spark):
    rng = np.random.default_rng(3)
    on = np.repeat([1.0, 0.0, 1.0, 0.0, 1.0, 0.0], [20, 4, 31, 9, 12, 14])
    rows = [("a", d, float(r), float(g)) for d, r, g in zip(DAYS, rng.normal(0, 0.01, 90), on, strict=True)] + [("flat", d, 0.01, 1.0) for d in DAYS]
    return spark.createDataFrame(rows, "book string, date date, net double, gate double")


def test_blocks_keep_every_row_and_runs_their_lengths(gate):
    s = positions(gate, ["book"]).cache()
    blocks = defaultdict(dict)
    for r in Q.shuffled_blocks(s, 5, 16).where("book = 'a'").collect():
        blocks[r["sim"]][r["pos"]] = r["gate"]
    assert len(blocks) == 5 and len({tuple(b[i] for i in range(90)) for b in blocks.values()}) == 5
    assert all(sorted(b) == list(range(90)) and sum(b.values()) == 63 for b in blocks.values())
    runs = defaultdict(dict)
    for r in Q.random_runs(s, 8).collect():
        assert r["book"] == "a"  # the other never changes
        runs[r["sim"]][r["pos"]] = r["gate"]
    assert len(runs) == 8
    own = {1.0: {20, 31, 12}, 0.0: {4, 9, 14}}
    for x in runs.values():
        assert sorted(x) == list(range(90))
        found = [(v, len(list(g))) for v, g in groupby(x[i] for i in range(90))]
        assert all(n in own[v] for v, n in found[:-1]) and found[-1][1] <= max(own[found[-1][0]])
    assert Counter((r["on"], r["length"]) for r in Q.gate_runs(s).where("book = 'a'").collect()) == Counter({(v > 0, n): 1 for v, ns in own.items() for n in ns})


def test_a_useful_gate_beats_its_placebos(spark, gate):
    good = gate.selectExpr("book", "date", "case when gate > 0 then 0.01 else -0.02 end as net", "gate").where("book = 'a'")
    got = {r["placebo"]: r for r in Q.placebo_gates(good, 40, 252, 16, 5, 8, 0.2).collect()}
    assert set(got) == {"blocks", "runs", "delayed", "calm"}
    assert all(r["share_below"] == 1.0 and r["actual"] > r["level"] for r in got.values())
    want = np.mean([0.0 if g else -np.log1p(-0.02) for g in np.repeat([1, 0, 1, 0, 1, 0], [20, 4, 31, 9, 12, 14])]) * 252
    assert np.isclose(got["runs"]["actual"], want)


def test_a_book_that_is_the_market_has_no_gamma_in_any_resample(spark):
    m = np.random.default_rng(4).normal(0.0005, 0.01, 200)
    rows = [(f"same{k}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(sum([x / k] * k)), float(x)) for k in (3, 7, 11) for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "book string, date date, net double, m double")
    gross = df.select("book").distinct().selectExpr("book", "1.0d as gross")
    got = Q.timing_verdicts(df, gross, spark.createDataFrame([], "book string, parent string"), 3, 252, sims=40, mean_block=5).collect()
    assert [r["boot_p"] for r in got] == [1.0] * 3
