"""Residual factors and expanding components against plain numpy."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest

from panelweave.operators import expanding_pca as X
from panelweave.operators import residual_factors as R
from panelweave.operators import spectrum as S

START = dt.date(2019, 1, 7)
DATES = [START + dt.timedelta(days=7 * i) for i in range(75)]
N_BETA, N_AN, NAMES = 26, 12, ["mkt", "other"]
SECTORS = {f"T{j:02d}": "abc"[j % 3] for j in range(18)}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    f = rng.normal(0, 0.02, (75, 2))
    hidden = rng.normal(0, 0.03, (75, 1))
    b, h = rng.normal(1, 0.5, (18, 2)), rng.normal(0, 1, (18, 1))
    r = f @ b.T + hidden @ h.T + rng.normal(0, 0.01, (75, 18))
    out = [(DATES[i], f"T{j:02d}", float(r[i, j])) for i in range(75) for j in range(18)]
    out = [(d, t, 0.0 if t == "T05" and i % 3 == 0 else v) for (d, t, v), i in zip(out, (k // 18 for k in range(len(out))), strict=True) if not (t == "T07" and d == DATES[-2])]
    return out, f


@pytest.fixture(scope="module")
def frames(spark, data):
    rows, f = data
    returns = spark.createDataFrame(rows, "date date, ticker string, ret double")
    factors = spark.createDataFrame([(d, float(a), float(b)) for d, (a, b) in zip(DATES, f, strict=True)], "date date, mkt double, other double")
    sectors = spark.createDataFrame(list(SECTORS.items()), "ticker string, sector string")
    return returns, factors, sectors


def plain(data, with_sectors):
    """win -> names, betas, residuals (names x dates), implied returns."""
    rows, f = data
    by = defaultdict(dict)
    for d, t, r in rows:
        by[t][d] = r
    out, end = {}, 75
    while end - N_AN - N_BETA >= 0:
        before, own = range(end - N_AN - N_BETA, end - N_AN), range(end - N_AN, end)
        names, blocks = [], []
        for t in sorted(by):
            parts = [[by[t].get(DATES[i]) for i in span] for span in (before, own)]
            if all(None not in p and np.std(p) > 0 and np.mean(np.array(p) == 0) <= 0.2 for p in parts):
                names.append(t)
                blocks.append(parts)
        x = np.column_stack([np.ones(N_BETA), f[list(before)]])
        sd = np.array([np.std(p, ddof=1) for p, _ in blocks])
        b = np.array([np.linalg.lstsq(x, np.array(p) / s, rcond=None)[0][1:] for (p, _), s in zip(blocks, sd, strict=True)])
        y = np.array([q for _, q in blocks]) / sd[:, None]
        m = np.column_stack([b, [[float(SECTORS[t] == s) for s in "abc"] for t in names]]) if with_sectors else b
        q, _ = np.linalg.qr(m)
        out[DATES[end - N_AN]] = names, b, y - q @ (q.T @ y), np.linalg.lstsq(m, y, rcond=None)[0], f[list(own)]
        end -= N_AN
    return out


@pytest.mark.parametrize("with_sectors", [False, True])
def test_residuals_equal_projections(frames, data, with_sectors):
    returns, factors, sectors = frames
    rows = R.analysis_windows(returns, factors, NAMES, N_BETA, N_AN)
    beta = R.betas(rows, NAMES)
    residual, implied = R.residuals(rows, beta, 2, *((sectors, ["a", "b", "c"]) if with_sectors else ()))
    want = plain(data, with_sectors)
    got, slopes = defaultdict(dict), defaultdict(dict)
    for r in residual.collect():
        got[r["win"]][r["ticker"], r["date"]] = r["ret"]
    for r in beta.collect():
        slopes[r["win"]][r["ticker"]] = r["beta"]
    assert set(got) == set(want) and len(want) == 4
    for win, (names, b, y, fit, _) in want.items():
        first = DATES.index(win)
        assert sorted(slopes[win]) == names and np.allclose([slopes[win][t] for t in names], b)
        assert np.allclose([[got[win][t, DATES[first + i]] for i in range(N_AN)] for t in names], y, atol=1e-9)
        own = {r["date"]: r["implied"] for r in implied.where(f"win = '{win}'").collect()}
        assert np.allclose([own[DATES[first + i]] for i in range(N_AN)], fit.T, atol=1e-7)


def test_angles_between_windows(frames, data):
    returns, factors, _ = frames
    got = {r["win"]: r for r in R.angles(R.betas(R.analysis_windows(returns, factors, NAMES, N_BETA, N_AN), NAMES), 2).collect()}
    want = plain(data, False)
    wins = sorted(want)
    assert sorted(got) == wins[1:]
    for a, b in zip(wins, wins[1:], strict=False):
        shared = sorted(set(want[a][0]) & set(want[b][0]))
        q = [np.linalg.qr(np.array([want[w][1][want[w][0].index(t)] for t in shared]))[0] for w in (a, b)]
        angle = np.sort(np.degrees(np.arccos(np.clip(np.linalg.svd(q[0].T @ q[1], compute_uv=False), -1, 1))))
        assert got[b]["shared"] == len(shared) and np.allclose(got[b]["angles"], angle, atol=1e-5) and np.isclose(got[b]["median"], np.median(angle), atol=1e-5)


def test_vetting_and_chained_series(frames, data):
    returns, factors, _ = frames
    rows = R.analysis_windows(returns, factors, NAMES, N_BETA, N_AN)
    residual, _ = R.residuals(rows, R.betas(rows, NAMES), 2)
    table, series = R.residual_factors(residual, factors, NAMES, k=3, most_local=0.9, least=5)
    got = {(r["win"], r["factor"]): r for r in table.collect()}
    kept = defaultdict(dict)
    for r in series.collect():
        kept[r["win"], r["factor"]][r["date"]] = r["x"]
    before, reasons = {}, set()
    for win, (names, _, y, _, f) in sorted(plain(data, False).items()):
        p, n = y.shape
        u, s, v = np.linalg.svd(y, full_matrices=False)
        theta = s**2 / (n * p)
        ell = np.pad(theta, (0, max(0, n - len(theta))))[3:n].mean()
        q, _ = np.linalg.qr(f - f.mean(axis=0))
        share = lambda x, q=q: ((q.T @ (x - x.mean())) ** 2).sum() / ((x - x.mean()) ** 2).sum()
        null = [share(np.roll(v[i], k)) for i in range(3) for k in range(1, n)]
        high, low = np.quantile(null, [0.99, 0.75])
        for i in range(3):
            r = got[win, i + 1]
            x = v[i] * s[i]
            snr, d, local = theta[i] / ell - 1, share(x), (x**2).max() / (x**2).sum()
            trusted = snr > 2 * np.sqrt(n / p) + n / p + 0.5
            assert np.allclose([r["snr"], r["r2"], r["local"]], [snr, d, local], atol=1e-8) and r["trusted"] == trusted
            assert r["bucket"] == ("noise-like" if not trusted else "likely-leaked" if d >= high else "candidate" if d < low else "mixed")
            fine = i > 0 and trusted and 0 <= ell / theta[i] <= 1 and not (d >= high and r["p"] < 0.01) and local <= 0.9
            assert (r["reason"] == "") == fine and ((win, i + 1) in kept) == fine
            reasons.add(r["reason"])
            own, shown = u[:, i].copy(), x.copy()
            if i in before:
                shared = [t for t in names if t in before[i]]
                turn = len(shared) >= 5 and np.corrcoef([before[i][t] for t in shared], [own[names.index(t)] for t in shared])[0, 1] < 0
            else:
                turn = own.sum() < 0
            if turn:
                own, shown = -own, -shown
            before[i] = dict(zip(names, own, strict=True))
            if fine:
                first = DATES.index(win)
                assert np.allclose([kept[win, i + 1][DATES[first + j]] for j in range(n)], shown, atol=1e-8)
    assert "first" in reasons and len(reasons) > 1


def test_expanding_components(spark):
    rng = np.random.default_rng(2)
    n, p, least, every, k = 31, 7, 10, 6, 3
    r = rng.normal(0, 1, (n, 2)) @ rng.normal(0.5, 1, (2, p)) + rng.normal(0.3, 0.3, (n, p))
    months = [dt.date(2010 + i // 12, i % 12 + 1, 1) for i in range(n)]
    rows = [(months[i], f"s{j}", float(r[i, j])) for i in range(n) for j in range(p)] + [(months[3], "gap", 0.5), (months[4], "s0x", None)]
    scores, load = X.component_returns(spark.createDataFrame(rows, "date date, signalname string, ret double"), k, least, every)
    got = {(x["date"], x["factor"]): x["ret"] for x in scores.collect()}
    used = defaultdict(dict)
    for x in load.collect():
        used[x["start"], x["factor"]][x["ticker"]] = x["load"]
    assert len(got) == (n - least) * k
    for i in range(least, n):
        fit = least + (i - least) // every * every
        past = r[:fit]
        _, _, v = np.linalg.svd(past - past.mean(axis=0), full_matrices=False)
        v = v[:k] * np.where(v[:k].sum(axis=1) < 0, -1, 1)[:, None]
        assert np.allclose([got[months[i], f + 1] for f in range(k)], v @ (r[i] - past.mean(axis=0)), atol=1e-9)
        assert all(np.allclose([used[fit, f + 1][f"s{j}"] for j in range(p)], v[f], atol=1e-9) for f in range(k))
    days = spark.createDataFrame([(d, i + 1) for i, d in enumerate(months)], "date date, pos int")
    tilts = spark.createDataFrame([(months[12], f + 1, float(f * f)) for f in range(k)] + [(months[13], 1, 2.0), (months[13], 2, 2.0)], "date date, factor int, tilt double")
    w = {x["ticker"]: x["w"] for x in X.signal_weights(load, days, tilts).collect()}
    t = np.array([0.0, 1.0, 4.0])
    want = (t - t.mean()) @ np.array([[used[10, f + 1][f"s{j}"] for j in range(p)] for f in range(k)])
    assert np.allclose([w[f"s{j}"] for j in range(p)], want / np.abs(want).sum())
    alike = X.signal_weights(load, days).where("date = date'2011-03-01'").collect()
    want = sum(np.array([used[10, f + 1][f"s{j}"] for j in range(p)]) for f in range(k))
    assert np.allclose([x["w"] for x in sorted(alike, key=lambda x: x["ticker"])], want / np.abs(want).sum())
    assert X.component_returns(spark.createDataFrame(rows[:20], "date date, signalname string, ret double"), k, least, every)[0].count() == 0


def test_no_windows_without_dates(frames):
    returns, factors, _ = frames
    rows = R.analysis_windows(returns.where(f"date < '{DATES[20]}'"), factors, NAMES, N_BETA, N_AN)
    assert rows.count() == 0 and R.betas(rows, NAMES).count() == 0
    assert S.spectrum(S.vectors(R.residuals(rows, R.betas(rows, NAMES), 2)[0], ["win"], centred=False), ["win"], 3, 1).count() == 0
