"""Grid, factor, learning and streaming jobs against plain loops."""

import datetime as dt

import numpy as np
import pytest

from panelweave.operators import covariance, factors
from panelweave.streaming import stateful

DAY = dt.date(2020, 1, 1)
days = [DAY + dt.timedelta(days=i) for i in range(60)]


def run(step, start, values):
    s, out = start, []
    for v in values:
        s, o = step(s, v)
        out.append(o)
    return out


def test_steps_hold_on_null_and_never_flip():
    assert run(stateful.bands(1.0, 0.2), (0,), [0.5, 1.2, None, -3.0, 0.1, -1.0, None]) == [0, -1, -1, -1, 0, 1, 1]
    assert run(stateful.counter(lambda v: v > 1), (0,), [2, 3, None, 0, 5]) == [1, 2, 2, 0, 1]
    assert run(stateful.on_change, (-1,), [1.0, 1.0, None, 0.0]) == [1, None, None, 0]


def test_slots_fill_deepest_first_and_free_up(spark):
    rows = [(days[0], "A", -1.0, False, True), (days[0], "B", -3.0, False, True), (days[0], "C", -2.0, False, True), (days[1], "A", -1.0, False, True), (days[1], "B", None, True, True), (days[1], "C", None, False, True), (days[2], "C", None, False, False), (days[2], "A", None, False, True)]
    df = spark.createDataFrame(rows, "date date, ticker string, depth double, leave boolean, priced boolean")
    got = sorted((r.date, r.ticker, r.age) for r in factors.slot_grid(df, [2], [5]).collect())
    assert got == [(days[0], "B", 1), (days[0], "C", 1), (days[1], "A", 1), (days[1], "C", 2), (days[2], "A", 2)]


def test_drift_resets_only_beyond_the_band(spark):
    w = spark.createDataFrame([("k", d, t, 0.5) for d in days[:3] for t in "AB"], "book string, date date, ticker string, w double")
    r = spark.createDataFrame([(days[1], "A", 0.5), (days[1], "B", 0.0), (days[2], "A", 0.01), (days[2], "B", 0.0)], "date date, ticker string, ret double")
    got = {(x.band, x.date): (x.net, x.turnover) for x in factors.drift_grid(w, r, [0.1, 10.0], [1.0]).collect()}
    assert got[0.1, days[0]] == pytest.approx((0.0, 1.0)) and got[10.0, days[0]] == pytest.approx((0.0, 0.0))
    assert got[0.1, days[1]] == pytest.approx((0.25, 0.2)) and got[0.1, days[2]] == pytest.approx((0.005, 0.0), abs=1e-9)


def test_loadings_and_subspace(spark):
    rng = np.random.default_rng(2)
    f, b = rng.normal(size=(3, 20)), rng.normal(1, 0.1, 5)
    rows = [(dt.date(2020, m + 1, 1), days[i], f"T{j}", float(f[m, i] * b[j] + rng.normal(0, 0.01))) for m in range(3) for i in range(20) for j in range(5)]
    load = factors.loadings(spark.createDataFrame(rows, "month date, date date, ticker string, ret double"), 1)
    assert all(r.share > 0.95 for r in load.collect())
    assert all(r.stability > 0.99 for r in factors.subspace_average(load, 3, 1).collect())
    assert {r.label for r in factors.vetting(load, 0.1, 0.9).collect()} == {"pervasive"}


@pytest.mark.parametrize("how", ["constant_correlation", "clip"])
def test_shrunk_keeps_variances(how):
    x = np.random.default_rng(1).normal(size=(40, 6)) @ np.random.default_rng(2).normal(size=(6, 6))
    c = covariance.shrunk(x, how)
    assert np.diag(c) == pytest.approx(x.var(axis=0, ddof=1)) and np.linalg.eigvalsh(c).min() > 0


def test_equal_correlation_intensity_by_loops():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 5)) @ rng.normal(0.4, 0.5, size=(5, 5)) + rng.normal(size=(30, 5))
    x = x - x.mean(axis=0)
    t, p = x.shape
    s = x.T @ x / t
    sd = np.sqrt(np.diag(s))
    mean = np.mean([s[i, j] / (sd[i] * sd[j]) for i in range(p) for j in range(p) if i != j])
    pi = rho = gamma = 0.0
    for i in range(p):
        for j in range(p):
            own = np.mean([(x[k, i] * x[k, j] - s[i, j]) ** 2 for k in range(t)])
            pi += own
            if i == j:
                rho += own
            else:
                theta = lambda a, b: np.mean([(x[k, a] ** 2 - s[a, a]) * (x[k, a] * x[k, b] - s[a, b]) for k in range(t)])
                rho += mean / 2 * (sd[j] / sd[i] * theta(i, j) + sd[i] / sd[j] * theta(j, i))
                gamma += (s[i, j] - mean * sd[i] * sd[j]) ** 2
    want = min(max((pi - rho) / gamma / t, 0.0), 1.0)
    assert covariance.equal_correlation_intensity(x, s, sd, mean) == pytest.approx(want) and 0 < want < 1


def _window(seed=1, p=6, months=3, n=20):
    rng = np.random.default_rng(seed)
    f, b = rng.normal(0, 0.02, (months, n)), rng.normal(1, 0.4, p)
    return [(dt.date(2020, m + 2, 1), dt.date(2020, m + 1, 1) + dt.timedelta(days=i), f"T{j}", float(f[m, i] * b[j] + rng.normal(0, 0.01))) for m in range(months) for i in range(n) for j in range(p)]


def _by_month(rows):
    out = {}
    for m in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == m]
        names, dates = sorted({r[2] for r in own}), sorted({r[1] for r in own})
        at = {(r[1], r[2]): r[3] for r in own}
        out[m] = names, np.array([[at[d, t] for t in names] for d in dates])
    return out


@pytest.mark.parametrize("how", ["sample", "identity", "factor", "constant_correlation", "clip"])
def test_min_variance_and_its_scoreboard(spark, how):
    rows = _window()
    frame = spark.createDataFrame(rows, "month date, date date, ticker string, ret double")
    weights = covariance.min_variance(frame, how, 0.3)
    got = {(r.month, r.ticker): r.w for r in weights.collect()}
    held = {}
    for m, (names, x) in _by_month(rows).items():
        c = np.cov(x, rowvar=False) if how == "sample" else covariance.shrunk(x, how)
        w = np.linalg.solve(c, np.ones(len(c)))
        w = np.clip(w / w.sum(), 0, 0.3)
        held[m] = dict(zip(names, w / w.sum(), strict=True))
        assert [got[m, t] for t in names] == pytest.approx(list(held[m].values()), abs=1e-6)
    after = spark.createDataFrame([(dt.date(2020, 2, 3) + dt.timedelta(days=i * 9), f"T{j}", 0.01 * ((i * 7 + j) % 5 - 2)) for i in range(9) for j in range(6)], "date date, ticker string, ret double")
    done = covariance.scoreboard(weights, after, 52).first()
    net = []
    for i in range(9):
        d = dt.date(2020, 2, 3) + dt.timedelta(days=i * 9)
        if d.replace(day=1) in held:
            net.append(sum(w * 0.01 * ((i * 7 + int(t[1])) % 5 - 2) for t, w in held[d.replace(day=1)].items()))
    months = sorted(held)
    assert done.n == len(net) and done.vol == pytest.approx(np.std(net, ddof=1) * 52**0.5, abs=1e-6)
    moved = [sum(abs(held[m][t] - (held[months[k - 1]][t] if k else 0)) for t in held[m]) for k, m in enumerate(months)]
    assert done.turnover == pytest.approx(np.mean(moved), abs=1e-5)


def test_components_projected_and_mapped_to_weights(spark):
    rows = _window(4)
    frame = spark.createDataFrame(rows, "month date, date date, ticker string, ret double")
    pca = {(r.month, r.factor): r for r in covariance.window_pca(frame, 2).collect()}
    load = factors.loadings(frame, 2)
    v = {}
    for r in load.collect():
        v.setdefault((r.month, r.factor), {})[r.ticker] = r.load
    for m, (_, x) in _by_month(rows).items():
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
        for k in (1, 2):
            assert pca[m, k].strength == pytest.approx(s[k - 1] ** 2 / 6) and pca[m, k].share == pytest.approx(s[k - 1] ** 2 / (s**2).sum())
    own = {(d, t): r for _, d, t, r in rows}
    scores = {(r.month, r.date, r.factor): r.score for r in factors.project(load, frame.select("date", "ticker", "ret")).collect()}
    assert scores and all(score == pytest.approx(sum(w * own[d, t] for t, w in v[m, k].items())) for (m, d, k), score in scores.items())
    tilts = spark.createDataFrame([(m, k, float(k * k)) for m, k in v], "month date, factor int, tilt double")
    for r in factors.signal_weights(load, tilts).collect():
        raw = {t: -1.5 * v[r.month, 1][t] + 1.5 * v[r.month, 2][t] for t in v[r.month, 1]}
        assert r.w == pytest.approx(raw[r.ticker] / sum(map(abs, raw.values())))


def test_gates_and_meta_features(spark):
    runs = [(f"t{i % 3}", days[i // 3], 0.1 * (i % 10), float(i % 4) - 1) for i in range(30)]
    got = factors.gate_positions(spark.createDataFrame(runs, "ticker string, start date, p double, pnl double"), 0.6, 0.7).first()
    order = sorted(runs, key=lambda r: (r[1], r[0]))
    early, late = [r for k, r in enumerate(order) if k / 29 < 0.6], [r for k, r in enumerate(order) if k / 29 >= 0.6]
    bar = np.percentile([r[2] for r in early], 70)
    assert got.bar == pytest.approx(bar) and got.kept == sum(r[2] >= bar for r in late) and got.dropped == len(late) - got.kept
    assert got.pnl_kept == pytest.approx(sum(r[3] for r in late if r[2] >= bar)) and got.pnl_all == pytest.approx(sum(r[3] for r in late))
    rows = spark.createDataFrame([(1, 1.0, "A"), (2, None, "B B"), (3, 4.0, None), (4, 2.0, "Z")], "id int, x double, c string")
    assert sorted(map(tuple, factors.meta_features(rows, ["x"], "c", ["A", "B B"]).collect())) == [(1, 1.0, 1.0, 0.0), (2, 2.0, 0.0, 1.0), (3, 4.0, 0.0, 0.0), (4, 2.0, 0.0, 0.0)]


def test_auc_and_clusters(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "y int, p double")
    assert factors.auc(df).first().auc == pytest.approx(0.875)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "ticker string")
    got = {r.ticker: r.cluster for r in factors.clusters(edges, nodes, lambda d: d.cache()).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_walk_forward_sees_only_known_labels(spark):
    rng = np.random.default_rng(3)
    rows = [(days[i], f"T{j}", int(v > 0), days[min(i + 2, 59)], [float(v)]) for i in range(60) for j in range(3) for v in [rng.normal()]]
    df = spark.createDataFrame(rows, "date date, ticker string, y int, known date, x array<double>")
    out = factors.walk_forward_logit(df, 20, 4)
    assert {r.fold for r in out.select("fold").distinct().collect()} == {2, 3, 4} and factors.auc(out).first().auc > 0.9
    late = factors.walk_forward_logit(df.selectExpr("date", "ticker", "y", "date'2021-01-01' as known", "x"), 20, 4)
    assert late.count() == 0
