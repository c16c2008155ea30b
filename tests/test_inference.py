"""Inference and exposure operators against numpy and plain loops."""

import datetime as dt

import numpy as np
import pytest

from panelweave.operators import alphas, exposure, inference

DAY = dt.date(2020, 1, 1)


def newey_west(y, x, lags):
    x = np.column_stack([np.ones(len(y)), *x])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    g = x * (y - x @ b)[:, None]
    s = g.T @ g
    for k in range(1, lags + 1):
        c = g[k:].T @ g[:-k]
        s += (1 - k / (lags + 1)) * (c + c.T)
    return b, b / np.sqrt(np.diag(inv @ s @ inv))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    m, h = rng.normal(0, 0.02, 150), rng.normal(0, 0.01, 150)
    return {"a": (0.001 + 0.8 * m - 0.3 * h + rng.normal(0, 0.01, 150), m, h), "b": (rng.normal(0, 0.01, 150), m, h)}


def test_nw_ols_matches_numpy(spark, data):
    rows = [(b, DAY + dt.timedelta(days=i), float(y[i]), float(m[i]), float(h[i])) for b, (y, m, h) in data.items() for i in range(150)]
    rows += [("a", DAY + dt.timedelta(days=400), None, 0.1, 0.1), ("flat", DAY, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "book string, date date, y double, m double, h double")
    got = {(r.book, r.term): (r.coef, r.t) for r in inference.nw_ols(df, ["book"], "y", ["m", "h"], 5).collect()}
    for book, (y, m, h) in data.items():
        b, t = newey_west(y, [m, h], 5)
        for i, term in enumerate(["const", "m", "h"]):
            assert got[book, term] == pytest.approx((b[i], t[i]), rel=1e-8)
    assert got["flat", "m"] == (None, None)


def test_nw_ols_of_nothing(spark):
    df = spark.createDataFrame([], "book string, date date, y double, m double")
    assert inference.nw_ols(df, ["book"], "y", ["m"], 3).collect() == []


def test_windows_hold_every_full_window(spark):
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i)) for i in range(23)], "book string, date date")
    got = inference.windows(df, ["book"], 10, 5).groupBy("start").count().collect()
    assert sorted((r.start, r["count"]) for r in got) == [(0, 10), (5, 10), (10, 10)]


def test_draws_cover_each_simulation(spark):
    sizes = spark.createDataFrame([("a", 33)], "book string, n long")
    for draws in (inference.block_draws(sizes, ["book"], 4, 10), inference.stationary_draws(sizes, ["book"], 4, 7)):
        rows = draws.collect()
        assert len(rows) == 4 * 33 and all(0 <= r.pos < 33 for r in rows) and len({(r.sim, r["at"]) for r in rows}) == 4 * 33


def test_row_band_follows_a_loop(spark):
    rng = np.random.default_rng(5)
    w = rng.normal(0, 0.3, (40, 3))
    rows = [("k", DAY + dt.timedelta(days=i), f"T{j}", float(w[i, j])) for i in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "book string, date date, ticker string, w double")
    got = {(r.date, r.ticker): r.w for r in exposure.row_band(df, df.select("date").distinct(), 0.9).collect()}
    held = np.zeros(3)
    for i in range(40):
        if np.abs(held - w[i]).sum() > 0.9:
            held = w[i]
        assert [got.get((DAY + dt.timedelta(days=i), f"T{j}"), 0.0) for j in range(3)] == pytest.approx(list(held))


def test_cluster_ols_leaves_one_out(spark, data):
    y, m, _ = data["a"]
    df = spark.createDataFrame([("k", i // 30, float(y[i]), float(m[i])) for i in range(150)], "key string, g int, y double, x double")
    r = inference.cluster_ols(df, "key", "g").first()
    slopes = [np.polyfit(np.delete(m, range(30 * g, 30 * g + 30)), np.delete(y, range(30 * g, 30 * g + 30)), 1)[0] for g in range(5)]
    assert (r.clusters, r.n) == (5, 150) and (r.least, r.most) == pytest.approx((min(slopes), max(slopes)), rel=1e-8)


def test_attribution_has_periods_cash_and_financing(spark, data):
    y, m, h = data["a"]
    cash = np.linspace(0.0002, 0.0004, 150)
    rows = [("a", DAY + dt.timedelta(days=i), float(y[i]), float(m[i]), None if i == 3 else float(h[i]), float(cash[i])) for i in range(150)]
    df = spark.createDataFrame(rows, "book string, date date, net double, m double, h double, cash double")
    periods = {"early": (str(DAY), str(DAY + dt.timedelta(days=59))), "short": (str(DAY), str(DAY + dt.timedelta(days=20)))}
    gross = spark.createDataFrame([("a", 1.8)], "book string, gross double")
    got = {(r.model, r.part, r.term): r for r in inference.attribution(df, "net", {"M0": [], "M1": ["m"], "M2": ["m", "h"]}, 5, gross, "cash", periods, 252).collect()}
    keep = np.array([i for i in range(150) if i != 3])
    parts = {"all": keep, "first": keep[:74], "second": keep[74:], "early": keep[keep < 60]}
    assert {p for _, p, _ in got} == set(parts)
    for part, i in parts.items():
        for model, xs in {"M0": [], "M1": [m[i]], "M2": [m[i], h[i]]}.items():
            b, t = newey_west(y[i] - cash[i], xs, 5)
            r = got[model, part, "const"]
            stressed = b[0] * 252 - 0.8 * (cash[i].mean() * 252 + 0.005)
            assert (r.n, r.coef, r.t, r.alpha, r.stressed) == (len(i), *(pytest.approx(v, rel=1e-8) for v in (b[0], t[0], b[0] * 252, stressed)))
            assert all(got[model, part, k].stressed is None for k in ["m", "h"][: len(xs)])


def bit(sim, pos):
    h = ((sim * 1009 + pos * 9176 + 12345) * 48271) % 2147483647
    return 1.0 if (h * h + 31 * h) % 2147483647 * 69621 % 2147483647 // 1024 % 2 == 0 else -1.0


def test_layered_alpha_climbs_the_whole_ladder(spark):
    rng = np.random.default_rng(11)
    n, size, sims = 165, 20, 400
    m, h, v = (0.004 + rng.normal(0, 0.01, n), rng.normal(0, 0.01, n), rng.normal(0, 0.01, n))
    cash, prem = np.full(n, 0.0003), rng.normal(0, 0.02, n)
    noise = rng.normal(0, 0.002, (4, n))
    books = {"sure": 0.004 + 0.3 * m + noise[0], "lent": 0.004 + 0.3 * m + noise[1], "beta": m + noise[2], "vol": 0.004 + prem + noise[3], "idle": noise[2] - noise[2].mean()}
    gross = {b: 200.0 if b == "lent" else 1.0 for b in books}
    rows = [(b, DAY + dt.timedelta(days=i), float(y[i]), float(m[i]), float(h[i]), float(v[i]), float(prem[i]), float(cash[i])) for b, y in books.items() for i in range(n)]
    df = spark.createDataFrame(rows, "book string, date date, net double, m double, h double, v double, premium double, cash double")
    layers = [[], ["m"], ["m", "h"], ["m", "h", "v"]]
    held = spark.createDataFrame(list(gross.items()), "book string, gross double")
    luck = spark.createDataFrame([(b, 0.9, 0.9) for b in books], "book string, sharpe_p double, trials_p double")
    got = {(r.book, r.layer): r for r in alphas.layered_alpha(df, layers, "premium", "cash", held, luck, size, sims, 252).collect()}
    count = n // size
    signs = np.array([[bit(s, w) for w in range(count)] for s in range(1, sims + 1)])
    for b, y in books.items():
        for k, xs in enumerate([[], [m], [m, h], [m, h, v]], 1):
            a = np.array([np.linalg.lstsq(np.column_stack([np.ones(size), *[x[i : i + size] for x in xs]]), y[i : i + size], rcond=None)[0][0] for i in range(0, count * size, size)])
            p = (np.abs((signs * a).mean(axis=1)) >= abs(a.mean()) - 1e-15).mean()
            r = got[b, k]
            assert (r.windows, r.mean, r.share, r.p) == (count, pytest.approx(a.mean(), rel=1e-6), max((a > 0).mean(), (a < 0).mean()), pytest.approx(p))
        assert (r.half1, r.half2) == pytest.approx((a[: count // 2].mean(), a[count // 2 :].mean()), rel=1e-6)
        assert r.stressed == pytest.approx(a.mean() * 252 - (gross[b] - 1) * (0.0003 * 252 + 0.005), rel=1e-6)
    assert {b: got[b, 1].label for b in books} == {"sure": "alpha", "lent": "mixed", "beta": "layer 2", "vol": "premium", "idle": "little"}


def test_sign_patterns_belong_to_a_window_not_to_its_place(spark):
    a = np.array([0.3, -0.1, 0.2, 0.5])
    df = spark.createDataFrame([("a", i, float(a[i])) for i in (0, 2, 3)], "book string, pos long, alpha double")
    r = inference.sign_flip(df, ["book"], 60).first()
    draws = np.array([[bit(s, i) * a[i] for i in (0, 2, 3)] for s in range(1, 61)]).mean(axis=1)
    assert r.p == pytest.approx((np.abs(draws) >= a[[0, 2, 3]].mean() - 1e-15).mean())


def test_an_exact_fit_has_no_t(spark, data):
    y, m, h = data["a"]
    books = {"market": m, "same": np.array([sum([x / 7] * 7) for x in m]), "level": np.full(150, 0.01), "other": y}
    rows = [(b, DAY + dt.timedelta(days=i), float(v[i]), float(m[i]), float(h[i])) for b, v in books.items() for i in range(150)]
    df = spark.createDataFrame(rows, "book string, date date, net double, m double, h double")
    got = {(r.book, r.term): r for r in inference.nw_ols(df, ["book"], "net", ["m", "h"], 5).collect()}
    assert [got[b, k].t for b in ("market", "same", "level") for k in ("const", "m", "h")] == [None] * 9
    assert got["same", "m"].coef == pytest.approx(1) and got["same", "m"].r2 == pytest.approx(1) and got["other", "m"].t == pytest.approx(newey_west(y, [m, h], 5)[1][1], rel=1e-8)
    parts = inference.windows(df.where("book <> 'level'"), ["book"], 52, 13)
    rolled = inference.nw_ols(parts, ["book", "start"], "net", ["m"], 4).groupBy("book").agg({"t": "count", "coef": "count"}).collect()
    assert {r.book: (r["count(t)"], r["count(coef)"]) for r in rolled} == {"market": (0, 16), "same": (0, 16), "other": (16, 16)}


def test_a_book_that_is_its_benchmark_has_no_t(spark, data):
    _, m, h = data["a"]
    books = {"same": np.array([sum([x / 7] * 7) for x in m]), "other": m + h}
    rows = [(b, DAY + dt.timedelta(days=i), float(v[i]), float(m[i])) for b, v in books.items() for i in range(150)]
    df = spark.createDataFrame(rows, "book string, date date, net double, bench double")
    got = {r.book: r for r in inference.forward_descriptive(df, 4, 40, 252).collect()}
    assert got["same"].t is None and got["same"].mean_gap == pytest.approx(0, abs=1e-12)
    assert got["other"].t == pytest.approx(newey_west(books["other"] - m, [], 4)[1][0], rel=1e-6)


def in_parts(m, k):
    """m, as a book of k equal shares of it would add it up."""
    return np.array([sum([x / k] * k) for x in m])


@pytest.fixture(scope="module")
def copies(spark, data):
    """Books that are the market up to rounding, and one that isn't."""
    _, m, h = data["a"]
    prem = np.random.default_rng(2).normal(0, 0.02, 150)
    books = {f"same{k}": in_parts(m, k) for k in (3, 5, 6, 7, 9, 11, 12, 13)} | {"other": 0.004 + 0.5 * m + prem * 0.1}
    rows = [(b, DAY + dt.timedelta(days=i), float(v[i]), float(m[i]), float(h[i]), float(prem[i])) for b, v in books.items() for i in range(150)]
    return spark.createDataFrame(rows, "book string, date date, net double, m double, h double, premium double")


def test_the_ladder_takes_no_side_where_nothing_is_left(copies):
    table, _ = alphas.alpha_ladder(copies, [[], ["m"], ["m", "h"]], "premium", 15, 40)
    got = {(r.book, r.layer): r for r in table.collect()}
    assert all((r.t, r.share, r.p) == (None, 0.0, 1.0) for (b, k), r in got.items() if b != "other" and k > 1)
    assert all(r.t is not None and r.share >= 0.5 for (b, k), r in got.items() if b == "other" or k == 1)


def test_labels_see_one_sign_in_halves_where_nothing_is_left(copies):
    _, labels = alphas.alpha_ladder(copies, [[], ["m"], ["m", "h"]], "premium", 15, 40)
    assert {r.halves for r in labels.where("book <> 'other'").collect()} == {True}


def test_no_alpha_of_rounding_counts_as_up(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((3e-19, -2e-18, 1e-17, 0.0))] + [("b", i, v) for i, v in enumerate((0.1, -0.1, 0.2, 0.3))], "book string, pos long, alpha double")
    assert {r.book: r.share_up for r in inference.sign_flip(df, ["book"], 20).collect()} == {"a": 0.0, "b": 0.75}
