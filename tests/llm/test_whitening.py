"""Whitening against numpy's eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from panelweave.llm import queries, whitening
from panelweave.llm.whitening import whiten
from tests.llm.conftest import SF


def plain(rows):
    """vec_id, component -> (n, deviation, whitened, explained), signs aside."""
    use = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in use), default=0)
    x = [(i, tuple([math.floor(256 * float(c)) for c in v] + [0] * (dim - len(v)))) for i, v in use]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit]).reshape(n, dim)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(n, 1)) if n and dim else (np.zeros(0), np.zeros((0, 0)))
    order = [k for k in np.argsort(-values)[:4] if values[k] > 1e-9 * values.max()]
    out = []
    for i, v in x:
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)])
        out += [(i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), c @ vectors[:, j] / math.sqrt(values[j]), values[j] / values.sum()) for k, j in enumerate(order)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def compare(df, rows):
    got = sorted(df.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["deviation"]))
    want = plain(rows)
    assert [tuple(r[:4]) for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rs if r[1] == k]) for rs in (got, want))
        assert np.allclose(a, b, rtol=1e-7, atol=1e-9) or np.allclose(a, -b, rtol=1e-7, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_equals_numpy_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(queries.op12_whitening(spark, SF), rows)


def test_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 1, 0.5, 0.1]).tolist()) for i in range(40)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, [-0.0] * 6), (105, []), (106, [0.5, -0.25])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, component string, n int")
    compare(whiten(df), rows)
    assert whiten(df.where("false")).count() == whiten(df.where("vec_id = 7")).count() == whiten(df.where("vec_id = 105")).count() == 0


@pytest.mark.parametrize("kind", ["flat", "thin", "steep"])
def test_fewer_dimensions_than_columns(spark, kind):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 3)).round(2)
    if kind == "flat":  # three dimensions in eight columns, exactly
        v = np.hstack([base, base[:, :1], np.ones((300, 1)), np.zeros((300, 3))])
    elif kind == "thin":  # one dimension
        v = np.outer(np.arange(300), [1.0, 2.0, 0.0, -1.0])
    else:  # scales that differ by 10^5
        v = np.hstack([base * 300, rng.normal(size=(300, 2))])
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    compare(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)


def test_whole_numbers_beyond_64_bits():
    c = whitening.Centre(10**9, [5, -(10**12)])
    x = np.array([[2**40, 1], [0, -3]])
    assert c.apart(x).tolist() == [[10**9 * 2**40 - 5, 10**9 + 10**12], [-5, -3 * 10**9 + 10**12]]
    assert c.deviation(x) == [None, None]
    assert whitening.Centre(3, [1, 2]).deviation(np.array([[1, 2], [0, 0]])) == [4 + 16, 1 + 4]


def test_substitution():
    rng = np.random.default_rng(1)
    upper = np.triu(rng.normal(size=(5, 5))) + 3 * np.eye(5)
    a = rng.normal(size=(9, 5))
    assert np.allclose(whitening.solved(a, upper) @ upper, a)
