"""Cluster-robust tests against dense regressions, resampled one by one."""

from itertools import product

import numpy as np
import pytest

from panelweave.operators import clusters as C


def fit(y, x, g):
    """Slopes, CR1 covariance and Wald statistic."""
    n, k = x.shape
    d = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(d.T @ d)
    b = inv @ d.T @ y
    u = y - d @ b
    scores = np.array([d[g == c].T @ u[g == c] for c in np.unique(g)])
    groups = len(scores)
    cov = (groups / (groups - 1) * (n - 1) / (n - k - 1) * inv @ (scores.T @ scores) @ inv)[1:, 1:]
    return b[1:], cov, b[1:] @ np.linalg.inv(cov) @ b[1:]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    out = []
    for key, groups, effect in (("none", 6, 0.0), ("strong", 7, 1.5)):
        for c in range(groups):
            shift = rng.normal()
            for _ in range(int(rng.integers(5, 12))):
                x = rng.normal(size=2)
                out.append((key, c, float(effect * x[0] + shift + rng.normal()), float(x[0] + 3), float(x[1] + 0.3 * shift)))
    return out + [("few", 0, 1.0, 2.0, 3.0), ("few", 1, 2.0, 1.0, 1.0), ("none", 0, None, 1.0, 1.0), ("none", None, 1.0, 1.0, 1.0)] + [("flat", i % 5, float(i * i % 7), 1.0, float(i)) for i in range(20)]


def test_slopes_wald_and_all_sign_vectors(spark, data):
    frame = spark.createDataFrame(data, "k string, g int, y double, a double, b double")
    sums = C.cluster_sums(frame, "k", "g", "y", ["a", "b"])
    slope = {(r["k"], r["term"]): r for r in C.slopes(sums, "k", ["a", "b"]).collect()}
    got = {r["k"]: r for r in C.wald(sums, "k", 2).collect()}
    assert set(got) == {"none", "strong"} and len(slope) == 4
    for key in got:
        own = [r for r in data if r[0] == key and None not in r]
        g, y, x = np.array([r[1] for r in own]), np.array([r[2] for r in own]), np.array([r[3:] for r in own])
        b, cov, w = fit(y, x, g)
        u = y - y.mean()
        null = []
        for signs in product([1, -1], repeat=len(np.unique(g))):
            null.append(fit(y.mean() + np.array(signs)[g] * u, x, g)[2])
        r = got[key]
        assert (r["n"], r["clusters"], r["draws"]) == (len(y), len(np.unique(g)), 2 ** len(np.unique(g)))
        assert np.isclose(r["wald"], w) and np.isclose(r["p_wild"], np.mean(np.array(null) >= w * (1 - 1e-9)))
        fitted = np.column_stack([np.ones(len(y)), x])
        assert np.isclose(r["r2"], 1 - ((y - fitted @ np.linalg.lstsq(fitted, y, rcond=None)[0]) ** 2).sum() / (u @ u))
        sd = x.std(axis=0, ddof=1)
        for i, term in enumerate("ab"):
            s = slope[key, term]
            without = [fit(y[g != c], x[g != c], g[g != c])[0][i] * sd[i] for c in np.unique(g)]
            assert np.allclose([s["slope"], s["t"], s["least"], s["most"]], [b[i] * sd[i], b[i] / cov[i, i] ** 0.5, min(without), max(without)])
            assert s["stable"] == all(np.sign(without) == np.sign(b[i]))
    assert got["strong"]["p_wild"] < 0.1 < got["none"]["p_wild"] and got["strong"]["p"] < 0.05


def test_many_clusters_take_draws(spark):
    rng = np.random.default_rng(1)
    rows = [("k", c, float(rng.normal() + (c % 3) * 0.01), float(rng.normal())) for c in range(30) for _ in range(4)]
    sums = C.cluster_sums(spark.createDataFrame(rows, "k string, g int, y double, a double"), "k", "g", "y", ["a"])
    a, b = (C.wald(sums, "k", 1, draws=d).first() for d in (600, 600))
    assert a == b and a["draws"] == 600 and 0.02 < a["p_wild"] < 1
    assert C.wald(sums.where("false"), "k", 1).count() == 0 == C.slopes(sums.where("false"), "k", ["a"]).count()
